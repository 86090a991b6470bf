"""Deduplication policies; the order of rows is always a column of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantera.functions.text import fold, slugify


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, whole."""
    row = F.struct(*[F.col(c) for c in df.columns])
    # A minimum over (order, row) aggregates before the shuffle, which a window can't.
    best = df.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], row.alias("_row"))).alias("_best"))
    return best.select("_best._row.*")


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, position): the last value of each key, at the place of the first."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias("position"))


def best_by(df: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """The row of each key that sorts first by ``rank`` (which has to be total)."""
    w = Window.partitionBy(*keys).orderBy(*rank)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def merged(df: DataFrame, key: str, item: str, order: str) -> DataFrame:
    """(key, position, items): distinct items of a key in order of first appearance."""
    first = df.groupBy(key, item).agg(F.min(order).alias("_at"))
    lists = first.groupBy(key).agg(F.min("_at").alias("position"), F.array_sort(F.collect_list(F.struct("_at", item))).alias("_items"))
    return lists.select(key, "position", F.transform("_items", lambda x: x[item]).alias("items"))


def fingerprint(kind: Column, name: Column, lat: Column, lng: Column, digits: int = 5) -> Column:
    """Type, folded name and rounded place; null without a place, so that such rows stay apart."""
    place = F.format_string(f"%.{digits}f,%.{digits}f", lat, lng)
    return F.when(lat.isNotNull() & lng.isNotNull(), F.concat_ws(":", kind, fold(name), place))


def occurrence_ids(df: DataFrame, key: str, order: list[Column], out: str = "unique_id") -> DataFrame:
    """Second and later rows of a key get a suffix ~n."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("~"), n)))


def unique_slugs(df: DataFrame, name: str, key: str, out: str = "slug", numbered: bool = True) -> DataFrame:
    """The first row of a slug keeps it; the others get a short hash of their key, and a number where that is taken too.

    Without ``numbered`` they get the hash alone, which 24 bits don't keep apart in large tables.
    """
    df = df.withColumn("_base", slugify(F.col(name)))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(key))
    text = F.col(key).cast("string")
    slug = F.when(n == 1, F.col("_base")).otherwise(F.concat(F.col("_base"), F.lit("-"), F.substring(F.sha1(text), 1, 6)))
    if not numbered:
        return df.withColumn(out, slug).drop("_base")
    # A suffixed slug may be another row's base or hash alike: bases come first, then keys.
    ranked = df.withColumn("_slug", slug)
    again = F.row_number().over(Window.partitionBy("_slug").orderBy(F.col("_slug") != F.col("_base"), key))
    return ranked.withColumn(out, F.when(again == 1, F.col("_slug")).otherwise(F.concat("_slug", F.lit("~"), again))).drop("_base", "_slug")


def violations(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keys that occur more than once, with their count and the first row's order."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
