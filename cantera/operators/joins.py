"""References between documents, fallbacks and spatial joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantera.functions.geo import cell, cells, haversine_m
from cantera.operators.pairs import spread

#: Tasks that share the points of a cell.
PARTS = 16


def deref(df: DataFrame, ref: str, target: DataFrame, key: str, take: dict[str, str], keep_missing: bool = True) -> DataFrame:
    """Columns of the row that a reference names; without it nulls, or no row."""
    t = target.select(F.col(key).alias("_key"), *[F.col(c).alias(a) for c, a in take.items()])
    return df.join(t, F.col(ref) == F.col("_key"), "left" if keep_missing else "inner").drop("_key")


def deref_array(df: DataFrame, key: str, refs: str, target: DataFrame, target_key: str, value: str, out: str) -> DataFrame:
    """Values of the rows that an array of references names, in the order of the array."""
    each = df.select(F.col(key).alias("_k"), F.posexplode(refs).alias("_pos", "_ref"))
    t = target.select(F.col(target_key).alias("_ref"), F.col(value).alias("_value"))
    lists = each.join(t, "_ref").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_pos", "_value"))).alias("_list"))
    lists = lists.select("_k", F.transform("_list", lambda x: x["_value"]).alias(out))
    return df.join(lists, df[key] == lists["_k"], "left").drop("_k").withColumn(out, F.coalesce(out, F.array().cast(f"array<{dict(target.dtypes)[value]}>")))


def fallback_union(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """All of ``first``, and what only ``second`` has."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"))


def unresolved(df: DataFrame, ref: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names nothing."""
    return df.filter(F.col(ref).isNotNull()).join(target.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def within_radius(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """Pairs (a_id, b_id, metres) at most so far apart; columns id, lat, lng; ids ascending.

    An equi-join on grid cells, each at least as wide as the radius at its latitude, then the
    exact distance. A cell's points on the left are dealt to ``PARTS`` tasks, each of which gets
    those on the right, as points may all stand in few cells.
    """
    size = metres / 111_000.0
    left = a.select(F.col("id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), F.explode(cells(F.col("lat"), F.col("lng"), size)).alias("_cell")).withColumn("_part", F.pmod(F.xxhash64("a_id"), F.lit(PARTS)))
    right = b.select(F.col("id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"), cell(F.col("lat"), F.col("lng"), size).alias("_cell")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    pairs = spread(left, "_cell", "_part").join(spread(right, "_cell", "_part"), ["_cell", "_part"]).filter("a_id < b_id").withColumn("metres", haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")))
    return pairs.filter(F.col("metres") <= metres).select("a_id", "b_id", "metres")
