"""Connected components of an edge table, by alternating large and small stars.

Every pass maps each node's neighbours to the smallest one; degrees may be as skewed as
they like, as the minima are pre-aggregated and only edges are joined. Passes are written
to shared storage, so a lost executor costs no more than a pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node to the smaller one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _down(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an edge can reach."""
    now = written(_down(edges, a, b).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        old, now = now, written(_small(_large(now)), "pass")
        discard(old)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    links = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return links.unionByName(links.select(F.col("root").alias("node"), "root").distinct())
