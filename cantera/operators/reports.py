"""Totals, lookups and orders of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantera.functions.text import fold
from cantera.functions.extract import long_words


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, whole; what a later lookup by the key finds."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def distinct_objects(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Distinct rows of the named columns as JSON with sorted names, and the order of the last of each."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return df.groupBy(text.alias("object")).agg(F.max(order).alias("last"))


def first_nonzero(*counts: Column) -> Column:
    """The first count that isn't zero, else zero."""
    return F.coalesce(*[F.when(c != 0, c) for c in counts], F.lit(0))


def uniform(df: DataFrame, attribute: str, value: str) -> DataFrame:
    """(attribute, value) of the attributes that have one value wherever they are given."""
    found = df.filter(F.col(value).isNotNull()).groupBy(attribute).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return found.filter("lo = hi").select(attribute, F.col("lo").alias(value))


def conflict_pairs(a: DataFrame, b: DataFrame, keys: list[str], text: str, negation: str) -> DataFrame:
    """Pairs of texts of two sides with equal keys of which exactly one is negated and that share a long word."""
    left = a.select(*keys, F.col(text).alias("a_text"), F.col(text).rlike(negation).alias("_na"), long_words(F.col(text)).alias("_wa"))
    right = b.select(*keys, F.col(text).alias("b_text"), F.col(text).rlike(negation).alias("_nb"), long_words(F.col(text)).alias("_wb"))
    return left.join(right, keys).filter("_na <> _nb").filter(F.arrays_overlap("_wa", "_wb")).select(*keys, "a_text", "b_text")


def first_match(items: DataFrame, prices: DataFrame, keys: list[str], name: str, order: str, value: str) -> DataFrame:
    """Items with the value of the first price whose folded name is theirs; null without one."""
    p = prices.select(*keys, fold(F.col(name)).alias("_name"), order, value).groupBy(*keys, "_name").agg(F.min_by(value, order).alias(value))
    return items.withColumn("_name", fold(F.col(name))).join(p, [*keys, "_name"], "left").drop("_name")


def collapsed_sources(df: DataFrame, key: Column, url_rank: Column, label_rank: Column) -> DataFrame:
    """(key, url, label, latest, position) of sources (url, label, accessed, ord) that are one page: the better address and label, the latest date, the first place."""
    best = lambda c, rank: F.min_by(c, F.struct(rank, "ord"))
    return df.groupBy(key.alias("key")).agg(best("url", url_rank).alias("url"), best("label", label_rank).alias("label"), F.max(F.substring("accessed", 1, 10)).alias("latest"), F.min("ord").alias("position"))


def attached(df: DataFrame, key: str, notes: DataFrame, order: list[Column], value: str, out: str, allowed: Column) -> DataFrame:
    """Rows with the values of their notes that may be shown, in order; an empty list without any."""
    lists = notes.filter(allowed).groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.col(value).alias("_v")))).alias("_l"))
    both = df.join(lists, F.col(key) == F.col("_key"), "left").drop("_key")
    none = F.array().cast(f"array<{dict(notes.dtypes)[value]}>")
    return both.withColumn(out, F.coalesce(F.transform("_l", lambda x: x["_v"]), none)).drop("_l")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a list, counted from 1, of 1 to 100 rows, with the totals of the whole list on each row."""
    size, number = min(100, max(1, size)), max(1, number)
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))  # one row of totals


def searched(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which the folded columns contain a folded text; all rows for an empty one."""
    needle = fold(F.lit(text))
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(fold(F.col(c)), needle)
    return df.filter((needle == "") | found)


def ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint"))


def markdown_table(df: DataFrame) -> Column:
    """A row of the frame as a row of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]), F.lit(" |"))
