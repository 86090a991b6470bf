"""Sinks: guarded replacement, upserts, conditional promotion, plan hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    """A path's constructor, its file system's context, and renaming in one step that fails rather than say so."""
    jvm = spark._jvm
    name = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(name(path).toUri(), spark._jsc.hadoopConfiguration())
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.NONE
    return name, context, lambda a, b: context.rename(name(a), name(b), options)


def replace_if(df: DataFrame, path: str, ok: bool) -> bool:
    """Replace a table if the run that made it is sound; else leave what is there.

    The new table is written whole beside the old one and renamed into its place. If writing
    or renaming fails, the old table is where it was, and the error is raised; the old one is
    deleted only after the new one has its place.
    """
    if not ok:
        return False
    path = path.rstrip("/")
    aside, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    name, files, rename = _files(df.sparkSession, path)
    try:
        df.write.parquet(aside)
        there = files.util().exists(name(path))
        if there:
            rename(path, old)
        try:
            rename(aside, path)
        except Exception:
            if there:
                rename(old, path)
            raise
    except Exception:
        files.delete(name(aside), True)
        raise
    if there:
        files.delete(name(old), True)
    return True


def create_or_replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``new``, and those of ``old`` that it doesn't replace."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def create_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``old``, and those of ``new`` whose key it doesn't have."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def promote(staged: DataFrame, published: DataFrame, key: str, outcome: str = "outcome") -> DataFrame:
    """Published rows after a check: passed rows in, failed and skipped ones out, others kept."""
    good = staged.filter(F.col(outcome).isin("PASS", "WARNING")).drop(outcome)
    return good.unionByName(published.join(staged.select(key), key, "left_anti"))


def append_claims(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Claims that aren't there yet, each once."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")


def plan_hash(**columns: Column) -> Column:
    """SHA-256 of named columns as JSON, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(columns.items())]), {"ignoreNullFields": "false"}), 256)


def sync_state(source: DataFrame, target: DataFrame, owned: DataFrame) -> DataFrame:
    """(path, action) for two inventories (path, hash) and the paths that this side has written."""
    s, t = source.withColumnRenamed("hash", "s"), target.withColumnRenamed("hash", "t")
    both = s.join(t, "path", "full").join(owned.select("path", F.lit(True).alias("own")), "path", "left")
    action = F.when(F.col("s").isNull(), "keep").when(F.col("t").isNull(), "create").when(F.col("s") == F.col("t"), "same").when(F.col("own"), "update").otherwise("conflict")
    return both.select("path", action.alias("action"))


def manifest(old: DataFrame, new: DataFrame, now: str, key: str = "id") -> DataFrame:
    """The manifest with new entries in place of old ones, all stamped, in the order of their keys."""
    return create_or_replace(old.drop("updated"), new, key).withColumn("updated", F.lit(now)).orderBy(key)


def phase_report(outcomes: DataFrame, domain: list[str]) -> DataFrame:
    """(outcome, n) for each outcome of the domain, and their total."""
    n = [F.count_if(F.col("outcome") == o).alias(o) for o in domain]
    one = outcomes.agg(*n, F.count("*").alias("total"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("n")) for o in [*domain, "total"]])).alias("r")).select("r.*")


def record_phase(reports: DataFrame, new: DataFrame, phases: list[str]) -> DataFrame:
    """Reports (topic, phase, outcome, stale) with new ones (topic, phase, outcome); later phases of their topics become stale."""
    rank = lambda c: F.array_position(F.array(*[F.lit(p) for p in phases]), c)
    first = new.groupBy(F.col("topic").alias("_topic")).agg(F.min(rank(F.col("phase"))).alias("_at"))
    old = reports.join(new.select("topic", "phase"), ["topic", "phase"], "left_anti").join(first, F.col("topic") == F.col("_topic"), "left")
    old = old.withColumn("stale", F.col("stale") | F.coalesce(rank(F.col("phase")) > F.col("_at"), F.lit(False))).drop("_topic", "_at")
    return old.unionByName(new.withColumn("stale", F.lit(False)))


def accepted(findings: DataFrame) -> DataFrame:
    """Findings as a new baseline."""
    return findings.distinct()
