"""Quality tiers, evidence gates and rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def useful(value: Column, sources: Column) -> Column:
    """A sourced value that isn't null, false, blank or an empty list."""
    text, kind = value.cast("string"), F.typeof(value)
    empty = (F.trim(text) == "") | ((kind == "boolean") & (text == "false")) | (F.startswith(kind, F.lit("array")) & (text == "[]"))
    return F.coalesce(F.size(sources) > 0, F.lit(False)) & F.coalesce(~empty, F.lit(False))


def tier(identity: Column, place: Column, distinctive: list[Column], what: Column, dimensions: list[Column], rich_at: int = 3) -> Column:
    """insufficient, basic or rich, with the number of dimensions as score."""
    count = lambda cs: sum((F.coalesce(c, F.lit(False)).cast("int") for c in cs), F.lit(0))
    score = count(dimensions)
    name = F.when(~(identity & place & (count(distinctive) > 0)), "insufficient").when(what & (score >= rich_at), "rich").otherwise("basic")
    return F.struct(name.alias("tier"), score.alias("score"))


def issues(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, code): a row for every rule that a row breaks; a rule that can't be evaluated isn't broken."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()]))
    return df.select(F.col(key), F.explode(broken).alias("code"))


def outcome(found: DataFrame, keys: DataFrame, key: str, severity: dict[str, int]) -> DataFrame:
    """(key, outcome): FAIL, WARNING or PASS by the worst code; unknown codes fail."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in severity.items() for x in kv])[F.col("code")], F.lit(2)) if severity else F.lit(2)
    worst = found.withColumn("_rank", rank).groupBy(key).agg(F.max("_rank").alias("_rank"))
    both = keys.select(key).distinct().join(worst, key, "left")
    return both.select(key, F.when(F.col("_rank") == 2, "FAIL").when(F.col("_rank") == 1, "WARNING").otherwise("PASS").alias("outcome"))


def coverage_gate(evidence: DataFrame, topic: str, entity: str, category: str, limits: dict[str, int]) -> DataFrame:
    """(topic, entities, weak entities, categories, passed): enough entities with enough kinds of evidence."""
    per = evidence.groupBy(topic, entity).agg(F.countDistinct(category).alias("kinds"))
    kinds = evidence.groupBy(topic).agg(F.countDistinct(category).alias("n_categories"))
    total = per.groupBy(topic).agg(F.count("*").alias("n_entities"), F.count_if(F.col("kinds") < limits["per_entity"]).alias("n_weak"))
    passed = (F.col("n_entities") >= limits["entities"]) & (F.col("n_weak") == 0) & (F.col("n_categories") >= limits["categories"])
    return total.join(kinds, topic).withColumn("passed", passed)


def merge_facts(first: Column, second: Column) -> Column:
    """Of two facts (value, sources): what only one has; the union of sources if they agree; else the first."""
    same = first["value"].eqNullSafe(second["value"])
    union = F.struct(first["value"].alias("value"), F.array_distinct(F.concat(first["sources"], second["sources"])).alias("sources"))
    return F.when(first.isNull() | first["value"].isNull(), second).when(second.isNull() | second["value"].isNull(), first).when(same, union).otherwise(first)


def merge_maps(a: Column, b: Column) -> Column:
    """Union of two maps; the second wins where it has a value."""
    return F.map_zip_with(F.coalesce(a, F.create_map().cast("map<string,string>")), F.coalesce(b, F.create_map().cast("map<string,string>")), lambda k, x, y: F.coalesce(y, x))
