"""Helpers the training-data operators share: tables, scratch space, prefix sums."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed word classes of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the driver and all executors share.

    Without ``spark.checkpoint.dir`` or a checkpoint folder, a session on this machine alone
    gets a temporary one; on a cluster that would lose data, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a Parquet table in shared storage, which outlives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more: what followed from it is written."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Let go of the shuffles that led to tables of ``written``.

    Spark deletes a shuffle's files once the driver's JVM has collected what refers to it,
    which in a large heap takes long; until then they fill the disk.
    """
    df.sparkSession._jvm.System.gc()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that at its end gives what it has freed back to the system.

    Python workers serve many tasks; without it they keep the most that any task has held.
    """

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def hold_memory() -> None:
    """Let this process keep freed blocks, of up to 64 MB in all, for the next arrays: mapping new pages takes longer than filling them."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 26)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


#: Rows that may be broadcast; of a few numbers each, they take some tens of MB.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table of narrow rows for broadcast if it is small; else it is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The words of a text, of characters outside U+0020 and U+0009 to U+000D."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def offsets(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group`` without one task per group.

    ``bucket`` cuts a group into ordered parts. Parts are summed first, the few sums per
    group are accumulated, and rows are accumulated within (group, bucket) only, so a
    group that holds a third of all rows is still dealt over all its buckets.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    base = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_base")
    same = [rows[k].eqNullSafe(base[f"_k{i}"]) for i, k in enumerate(keys)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = rows.join(base, cond)
    return joined.withColumn(out, F.col("_in") + F.col("_base")).drop("_in", "_base", *[f"_k{i}" for i in range(len(keys))])
