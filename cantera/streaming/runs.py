"""Structured Streaming over a landing folder of sightings and run logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _parts(spark: SparkSession, root: str) -> tuple[int, list[int], object, object]:
    """The last compacted batch (-1 without one), the numbers of the deltas after it, and the root's file system and path class.

    A folder counts once its writer has committed it.
    """
    name = spark._jvm.org.apache.hadoop.fs.Path
    files = name(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in files.listStatus(name(root))] if files.exists(name(root)) else []
    done = [n for n in found if re.fullmatch(r"(base|delta)-\d+", n) and files.exists(name(f"{root}/{n}/_SUCCESS"))]
    base = max((int(n[5:]) for n in done if n.startswith("base-")), default=-1)
    return base, sorted(int(n[6:]) for n in done if n.startswith("delta-") and int(n[6:]) > base), files, name


def catalogue(spark: SparkSession, root: str, key: str, key_type: str, seen_type: str) -> DataFrame:
    """(key, first_seen, last_seen, n) as of the last batch: the base and the deltas after it, merged on read."""
    schema = f"{key} {key_type}, first_seen {seen_type}, last_seen {seen_type}, n bigint"
    base, deltas, _, _ = _parts(spark, root)
    paths = ([f"{root}/base-{base}"] if base >= 0 else []) + [f"{root}/delta-{k}" for k in deltas]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"))


def compact(spark: SparkSession, root: str, key: str, key_type: str, seen_type: str) -> int:
    """Merge the base and all deltas into a new base and delete what it replaces but the base before, which readers may still have open."""
    base, deltas, files, name = _parts(spark, root)
    if not deltas:
        return base
    catalogue(spark, root, key, key_type, seen_type).write.mode("overwrite").parquet(f"{root}/base-{deltas[-1]}")
    for x in files.listStatus(name(root)):
        m = re.fullmatch(r"(base|delta)-(\d+)", x.getPath().getName())
        if m and (m[1] == "delta" and int(m[2]) <= base or m[1] == "base" and int(m[2]) < base):
            files.delete(x.getPath(), True)
    return deltas[-1]


def upsert_stream(sightings: DataFrame, root: str, key: str, seen: str, key_type: str, seen_type: str, compact_every: int = 20) -> StreamingQuery:
    """Keep a catalogue of sightings up to date: a delta a batch, merged on read and compacted now and then.

    A batch writes what it has seen, by key, under its own number, so bytes go with the
    batch and not with the catalogue, and a batch that is repeated after a failure replaces
    its delta: nothing counts twice. A batch without rows, as of a run that failed, writes an
    empty delta and changes nothing. A base holds all batches up to its number.
    """
    spark = sightings.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        if _parts(spark, root)[0] >= number:
            return  # a repeated batch that a base already holds
        rows = batch.groupBy(F.col(key).cast(key_type).alias(key)).agg(F.min(seen).cast(seen_type).alias("first_seen"), F.max(seen).cast(seen_type).alias("last_seen"), F.count("*").alias("n"))
        rows.write.mode("overwrite").parquet(f"{root}/delta-{number}")
        if (number + 1) % compact_every == 0:
            compact(spark, root, key, key_type, seen_type)

    return sightings.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def phase_counts(logs: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Log lines per window and level; lines later than ``late`` are left out."""
    return logs.withWatermark(ts, late).groupBy(F.window(ts, width), "level").agg(F.count("*").alias("n"))
