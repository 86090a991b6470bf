"""Upserts with history, phase staleness and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, seen: str) -> DataFrame:
    """(key, first_seen, last_seen, n, change) after a batch of sightings.

    ``old`` has (key, first_seen, last_seen, n), ``new`` (key, seen) with repeats.
    """
    batch = new.groupBy(F.col(key).alias("_key")).agg(F.min(seen).alias("_first"), F.max(seen).alias("_last"), F.count("*").alias("_n"))
    both = old.join(batch, old[key] == batch["_key"], "full")
    change = F.when(F.col(key).isNull(), "new").when(F.col("_key").isNull(), "not seen").otherwise("seen again")
    return both.select(
        F.coalesce(key, "_key").alias(key),
        F.least("first_seen", "_first").alias("first_seen"),
        F.greatest("last_seen", "_last").alias("last_seen"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"),
        change.alias("change"),
    )


def phase_staleness(df: DataFrame, phases: list[str]) -> DataFrame:
    """A flag for each phase's finish time: an earlier phase that isn't stale itself ended later."""
    stale = []
    for k, p in enumerate(phases):
        flag = F.lit(False)
        for earlier, was in zip(phases[:k], stale, strict=True):
            flag = flag | (~was & F.coalesce(F.col(earlier) > F.col(p), F.lit(False)))
        stale.append(F.when(F.col(p).isNull(), False).otherwise(flag))
    for p, s in zip(phases, stale, strict=True):
        df = df.withColumn(f"{p}_stale", s)
    return df


def sections(df: DataFrame, group: str, order: str, is_heading, heading: str) -> DataFrame:
    """Rows with the last heading up to them, and their section's number."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("section", F.last(F.when(is_heading, F.col(heading)), ignorenulls=True).over(w))
    return df.withColumn("section_no", F.sum(is_heading.cast("bigint")).over(w))


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows, as a log that drops its oldest."""
    return df.orderBy(F.desc(order)).limit(n)

