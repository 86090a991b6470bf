"""Counts over fixed domains, coverage, gates, facets and fact resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_filled(counts: DataFrame, domain: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Counts for every member of the domain; 0 where there are none."""
    return domain.join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def ratio(part: Column, total: Column) -> Column:
    """Percent with one decimal; 0 of nothing."""
    return F.when(total == 0, 0.0).otherwise(F.round(part * 100.0 / total, 1))


def correlated_count(outer: DataFrame, inner: DataFrame, key: str, ref: str, counted: str, least: int) -> DataFrame:
    """Rows of ``outer`` that at least ``least`` distinct rows of ``inner`` refer to, with the count."""
    counts = inner.filter(F.col(ref).isNotNull()).groupBy(ref).agg(F.countDistinct(counted).alias("n"))
    return outer.join(counts, outer[key] == counts[ref], "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") >= least)


def differentiated(facts: DataFrame, dimension: str, entity: str, value: Column, entities: int = 2, values: int = 2) -> DataFrame:
    """Dimensions with enough entities and enough distinct values."""
    found = facts.withColumn("_v", value).groupBy(dimension).agg(F.countDistinct(entity).alias("n_entities"), F.countDistinct("_v").alias("n_values"))
    return found.filter((F.col("n_entities") >= entities) & (F.col("n_values") >= values))


def resolve_facts(claims: DataFrame, fact: list[str], value: str, rank: list[Column]) -> DataFrame:
    """Status of each fact: its best claim's value, or a conflict if claims differ."""
    counts = claims.groupBy(*fact).agg(F.count("*").alias("n_claims"), F.countDistinct(value).alias("n_values"))
    best = claims.withColumn("_rn", F.row_number().over(Window.partitionBy(*fact).orderBy(*rank))).filter("_rn = 1").select(*fact, F.col(value).alias("best_value"))
    status = F.when(F.col("n_values") == 0, "unknown").when(F.col("n_values") > 1, "conflict").otherwise("confirmed")
    return counts.join(best, fact).withColumn("status", status)


def top_per_group(counts: DataFrame, group: str, n: str, name: str, k: int) -> DataFrame:
    """The k largest of each group, ties by name."""
    w = Window.partitionBy(group).orderBy(F.desc(n), F.asc(name))
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def facet(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, sorted, as rows (facet, value)."""
    return df.filter(F.col(column).isNotNull()).select(F.lit(column).alias("facet"), F.col(column).cast("string").alias("value")).distinct()


def map_totals(df: DataFrame, group: list[str], maps: dict[str, list[str] | None]) -> DataFrame:
    """One row a group: for each map column the sums by key, keys in order; keys of a given domain are there with 0, others are summed too.

    All maps are exploded together and summed in one aggregation, which combines before its
    shuffle; groups without entries have their domains' zeros. Null maps and values count as 0.
    """
    entry = lambda name: F.transform(F.map_entries(F.coalesce(F.col(name), F.create_map().cast("map<string,double>")).cast("map<string,double>")), lambda e: F.struct(F.lit(name).alias("name"), e["key"].alias("key"), F.coalesce(e["value"], F.lit(0.0)).alias("value")))
    zeros = lambda name, domain: F.array(*[F.struct(F.lit(name).alias("name"), F.lit(k).alias("key"), F.lit(0.0).alias("value")) for k in domain])
    parts = [entry(m) for m in maps] + [zeros(m, d) for m, d in maps.items() if d] + [F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("key"), F.lit(0.0).alias("value")))]
    rows = df.select(*group, F.explode(F.concat(*parts)).alias("_e")).groupBy(*group, "_e.name", "_e.key").agg(F.sum("_e.value").alias("_n"))
    lists = rows.groupBy(*group).agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("name") == m, F.struct("key", F.col("_n")))))).alias(m) for m in maps])
    return lists


def first_nonzero(*counts: Column) -> Column:
    """The first count that isn't 0 or null; else 0."""
    out = F.lit(0)
    for c in reversed(counts):
        out = F.when(F.coalesce(c, F.lit(0)) != 0, c).otherwise(out)
    return out
