"""Topic selection: phrase match, capped scores, total order, top-k with the overflow kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantera.functions.text import contains_phrase, fold, once
from cantera.sources.store import stored


def matched_terms(df: DataFrame, text: str, terms: list[str], out: str) -> DataFrame:
    """Matched phrases of a text; one that a longer match contains is dropped; longest first."""

    def hits(folded: Column) -> Column:
        return F.array_compact(F.array(*[F.when(contains_phrase(folded, F.lit(t)), F.lit(t)) for t in terms]))

    def longest(found: Column) -> Column:
        inside = F.filter(found, lambda t: ~F.exists(found, lambda u: (u != t) & F.contains(F.concat(F.lit(" "), u, F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" ")))))
        return F.array_sort(inside, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))

    found = once(once(fold(F.col(text)), hits), longest)
    return df.withColumn(out, F.coalesce(found, F.array().cast("array<string>")))


def select_topic(docs: DataFrame, key: str, text: str, terms: list[str], useful: dict[str, float], limit: int) -> DataFrame:
    """Candidates with score, rank and outcome: selected, or excluded and why.

    ``useful`` gives columns and the weight of each if it has a value; relevance is 20 for
    each matched term, 60 at most. Rows beyond ``limit`` are kept as excluded ones. Equal
    rows share a rank.
    """
    # Read twice, by the top-k and by what it is joined to: the texts are folded and matched once.
    rows = stored(matched_terms(docs, text, terms, "terms"), "topic")
    relevance = F.least(F.lit(60), F.size("terms") * 20).cast("double")
    coverage = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in useful.items()), F.lit(0.0))
    rows = rows.withColumn("relevance", relevance).withColumn("coverage", coverage).withColumn("score", F.col("relevance") + F.col("coverage"))
    # Only the best rows are sorted: a top-k, joined back by its key and a hash of the row.
    whole = F.xxhash64(*docs.columns)
    order = [F.desc("score"), F.desc("relevance"), F.desc("coverage"), F.asc(key), F.asc("_row")]
    top = rows.filter(F.size("terms") > 0).select("score", "relevance", "coverage", key, whole.alias("_row")).orderBy(*order).limit(limit)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")).groupBy(F.col(key).alias("_key"), "_row").agg(F.min("rank").alias("rank"))
    rows = rows.join(F.broadcast(top), F.col(key).eqNullSafe(F.col("_key")) & (whole == F.col("_row")), "left").drop("_key", "_row")
    outcome = F.when(F.size("terms") == 0, "no match").when(F.col("rank").isNotNull(), "selected").otherwise("over limit")
    return rows.withColumn("outcome", outcome)
