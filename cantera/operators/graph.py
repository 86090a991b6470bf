"""Pages as a link graph: fields, edges, degrees, duplicate groups, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.functions.urls import host


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, first heading, counts of headings and links, robots and language, by patterns."""
    h = F.col(html)
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"[ \t\n\r\f]+", " "))
    return (
        pages.withColumn("title", text(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)))
        .withColumn("h1", text(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1)))
        .withColumn("n_h1", F.regexp_count(h, F.lit(r"(?i)<h1[ >]")).cast("bigint"))
        .withColumn("n_links", F.regexp_count(h, F.lit(r"(?i)<a\s[^>]*href=")).cast("bigint"))
        .withColumn("lang", F.regexp_extract(h, r"(?i)<html[^>]*\slang=\"([^\"]*)\"", 1))
        .withColumn("page_type", F.when(h.rlike(r"(?i)<meta[^>]*http-equiv=\"?refresh"), "redirect").when(h.rlike(r"(?i)<meta[^>]*name=\"?robots\"?[^>]*noindex"), "noindex").otherwise("indexable"))
    )


def duplicate_groups(df: DataFrame, key: str, value: Column) -> DataFrame:
    """One row per member of a group of two or more: its value, the group's size and first key."""
    rows = df.select(F.col(key), value.alias("value")).filter(F.coalesce("value", F.lit("")) != "")
    groups = rows.groupBy("value").agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")
    return rows.join(groups, "value")


def listed_diff(listed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, finding): listed but absent, or present but not listed."""
    a = listed.select(key).distinct().withColumn("_l", F.lit(1))
    b = present.select(key).distinct().withColumn("_p", F.lit(1))
    both = a.join(b, key, "full").filter("_l is null or _p is null")
    return both.select(key, F.when(F.col("_p").isNull(), "listed-not-present").otherwise("present-not-listed").alias("finding"))
