"""A keyed cache of results as a table: looked up by fingerprint, version and age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sinks import plan_hash

VERSION = 1


def fingerprint(**inputs: Column) -> Column:
    """Names what a result was made from; the order of the inputs doesn't matter."""
    return plan_hash(**inputs)


def load(wanted: DataFrame, cache: DataFrame, now: str, days: int) -> DataFrame:
    """Wanted rows (fingerprint, …) with ``result``; null where the cache has none of this version that is 0 to ``days`` old.

    ``cache`` has fingerprint, version, stored (a timestamp) and result; of several entries
    the latest counts.
    """
    age = F.lit(now).cast("timestamp").cast("double") - F.col("stored").cast("timestamp").cast("double")
    good = cache.filter((F.col("version") == VERSION) & age.between(0, days * 86400))
    latest = good.groupBy("fingerprint").agg(F.max_by("result", "stored").alias("result"))
    return wanted.join(latest, "fingerprint", "left")


def save(cache: DataFrame, made: DataFrame, now: str) -> DataFrame:
    """The cache with new results (fingerprint, result); they replace those of the same fingerprint."""
    new = made.select("fingerprint", F.lit(VERSION).alias("version"), F.lit(now).cast("timestamp").alias("stored"), "result")
    return cache.join(made.select("fingerprint"), "fingerprint", "left_anti").unionByName(new)
