"""Size-tiered shards with versioned manifests: DataFrame functions only.

Arrivals are appended as small immutable Parquet shards. Compaction takes the shards of the
same size tier (sizes within a factor ``FANOUT``), cuts them into runs of about the target
size and rewrites each run of two or more as one file; larger shards stay. A version of the
table is a manifest, a small Parquet table of (path, rows, bytes, tier) that is written
aside and renamed to its number in one step, which fails if the number is taken: readers
see the old or the new version, and of two writers one has to try again. Shards that no
manifest names are invisible; older versions stay readable until ``vacuum``.

Only shard figures are planned, as a DataFrame; rows are moved once per compaction, to the
task that writes their run. Defined results: an empty table has a manifest without shards;
rows are kept as they are, repeated ones and nulls included; columns may have any names.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, offsets, scratch, table

TARGET_BYTES = 64 << 20
#: A shard of this share of the target is left alone.
FULL = 0.75
#: Ratio of the sizes from one tier to the next.
FANOUT = 4
#: Rows of a shard of arrivals, at most.
ARRIVAL_ROWS = 10_000
#: Shards whose sizes are accumulated by one task, about.
PLAN_ROWS = 10_000
#: Seconds after which data that no version names is nobody's.
ORPHAN_AGE = 7 * 24 * 3600

MANIFEST = "path string, rows bigint, bytes bigint, tier int"


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/v{version if version is not None else known[-1]:09d}")


def commit(spark: SparkSession, root: str, shards: DataFrame, version: int) -> int:
    """Publish ``shards`` as this version; fails if it exists."""
    aside = f"{root}/manifests/_new-{uuid.uuid4().hex}"
    shards.coalesce(1).write.parquet(aside)
    jvm, files = _files(spark, root)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    path = jvm.org.apache.hadoop.fs.Path
    try:
        files.rename(path(aside), path(f"{root}/manifests/v{version:09d}"), options)
    except Exception as e:
        files.delete(path(aside), True)
        if version in versions(spark, root):
            raise Conflict(f"version {version} of {root} is taken") from e
        raise
    return version


def _next(spark: SparkSession, root: str) -> int:
    return max(versions(spark, root), default=0) + 1


def _described(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows of the files in a folder; no column of theirs is read."""
    files = spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    rows = files.groupBy("path", "bytes").agg(F.count("*").alias("rows"))
    tier = F.greatest(F.lit(0), F.floor(F.log(float(FANOUT), F.col("bytes").cast("double")))).cast("int")
    return rows.select("path", "rows", "bytes", tier.alias("tier"))


def append(docs: DataFrame, root: str, arrival_rows: int = ARRIVAL_ROWS) -> int:
    """Write arrivals as new small shards and commit them; returns the version."""
    spark = docs.sparkSession
    version = _next(spark, root)
    folder = f"{root}/data/{uuid.uuid4().hex}"
    docs.write.option("maxRecordsPerFile", arrival_rows).option("compression", "zstd").parquet(folder)
    return commit(spark, root, manifest(spark, root).unionByName(_described(spark, folder)), version)


def plan(shards: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """(path, run) of the shards to merge; runs count up from 0, with gaps."""
    small = shards.filter(F.col("bytes") < target_bytes * FULL)
    parts = max(1, small.count() // PLAN_ROWS)
    small = small.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int"))
    placed = offsets(small, ["tier"], "part", [F.col("bytes"), F.col("path")], "bytes", "at").withColumn("k", F.floor(F.col("at") / target_bytes))
    runs = placed.groupBy("tier", "k").agg(F.count("*").alias("n")).filter("n > 1")
    most = {r["tier"]: r["k"] + 1 for r in runs.groupBy("tier").agg(F.max("k").alias("k")).collect()}  # a number for each tier
    base, at = F.lit(None).cast("bigint"), 0
    for t in sorted(most):
        base = F.when(F.col("tier") == t, F.lit(at)).otherwise(base)
        at += most[t]
    return placed.join(runs, ["tier", "k"]).select("path", (base + F.col("k")).cast("int").alias("run"))


def compact(spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES) -> int | None:
    """One compaction; returns the new version, or None if nothing is to merge."""
    version = _next(spark, root)
    shards = manifest(spark, root)
    runs = plan(shards, target_bytes)
    store = f"{root}/plans/{uuid.uuid4().hex}"
    runs.write.parquet(store)
    runs = spark.read.schema("path string, run int").parquet(store)
    n = runs.agg(F.max("run")).first()[0]
    if n is None:
        return None
    folder = f"{root}/data/{uuid.uuid4().hex}"
    rows = _open(spark, root, [r["path"] for r in shards.join(runs, "path", "left_semi").select("path").collect()])
    names = rows.columns
    mark, path = "_run", "_path"
    while mark in names or path in names:
        mark, path = mark + "_", path + "_"
    rows = rows.withColumn(path, F.col("_metadata.file_path")).join(bounded(runs.select(F.col("path").alias(path), F.col("run").alias(mark))), path)
    rows = rows.repartitionById(n + 1, F.col(mark)).select(*[F.col(f"`{c}`") for c in names])
    rows.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(folder)
    kept = shards.join(runs, "path", "left_anti")
    return commit(spark, root, kept.unionByName(_described(spark, folder)), version)


def _open(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """Rows of the shards; their paths are what Spark's own file index holds."""
    if not paths:
        return spark.read.parquet(f"{root}/data/*").limit(0)
    return spark.read.option("basePath", f"{root}/data").parquet(*paths)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return _open(spark, root, [r["path"] for r in manifest(spark, root, version).select("path").collect()])


def vacuum(spark: SparkSession, root: str, orphan_age: float = ORPHAN_AGE) -> int:
    """Delete all versions but the last, and shards that it doesn't name; returns the files deleted.

    Folders of data that no version names are those of writers that lost or died, or of one
    that still writes; they go when nothing in them has changed for ``orphan_age`` seconds.
    """
    jvm, files = _files(spark, root)
    path = jvm.org.apache.hadoop.fs.Path
    old = versions(spark, root)[:-1]
    keep = manifest(spark, root).select("path")
    gone = 0
    for v in old:
        for r in manifest(spark, root, v).join(keep, "path", "left_anti").collect():
            gone += bool(files.delete(path(r["path"]), False))
    for v in old:
        files.delete(path(f"{root}/manifests/v{v:09d}"), True)
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    data = path(f"{root}/data")
    named = {r[0] for r in keep.select(F.element_at(F.split("path", "/"), -2)).distinct().collect()}  # a folder for each append or compaction
    before = (time.time() - orphan_age) * 1000
    for folder in fs.listStatus(data) if fs.exists(data) else []:
        if folder.isDirectory() and folder.getPath().getName() not in named:
            held = fs.listStatus(folder.getPath())
            if max([folder.getModificationTime(), *[f.getModificationTime() for f in held]]) < before:
                gone += sum(f.isFile() and f.getPath().getName().startswith("part-") for f in held)
                fs.delete(folder.getPath(), True)
    return gone


def shard(docs: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Append the documents, compact, and read the committed version back."""
    spark = docs.sparkSession
    root = root or scratch(spark, "shards")
    append(docs, root)
    compact(spark, root, target_bytes)
    return read(spark, root)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("text_bytes"), F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS text_bytes, sha256(text) AS text_sha256 FROM documents
"""
