"""Quality rules, line first: DataFrame functions only.

Every line is judged by itself: too much punctuation, navigation (separators between short
items), boilerplate phrases, shouting (no lower-case letter). Failing lines are taken out,
and a document that loses more than ``MAX_LOST_PERCENT`` of its solid characters that way
is rejected, as is one that fails the base rules (few words, or repeated three-word windows).

All is computed within the row, so nothing is shuffled. Defined results: a null text counts
as an empty one, which has no words and fails the base rules; repeated rows are judged one
by one; columns of the input are kept. Repeated windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 30

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
MARKS = "!\"#$%&()*+/:;<=>?@[\\]^_`{|}~"
SEPARATORS = "|>»·•"
MAX_MARKS_PERCENT = 15
MIN_SEPARATORS = 2
MAX_SPACES_PER_SEPARATOR = 6
MIN_SHOUT = 10
BOILERPLATE = r"(?i)(licensed under|all rights reserved|terms of (use|service)|privacy policy|accept (all )?cookies|enable javascript|subscribe to our|click here|sign up for)"

HEADS = ("licensed under", "all rights reserved", "terms of ", "privacy policy", "accept ", "enable javascript", "subscribe to our", "click here", "sign up for")

#: Distinct repeated windows up to which their places are found by look-up; beyond, by a sort.
FEW = 16


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit("[" + re.sub(r"([\[\]\\^&-])", r"\\\1", chars) + "]"))


def _solid(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def _boilerplate(line: Column) -> Column:
    """The phrases are looked for where the words that they start with are."""
    some = F.lit(False)
    for head in HEADS:
        some = some | F.contains(F.lower(line), F.lit(head))
    return some & line.rlike(BOILERPLATE)


def line_failure(line: Column) -> Column:
    """The first rule that a line fails, or null; cheap conditions come first."""
    marks, separators = _count(line, MARKS), _count(line, SEPARATORS)
    white = F.length(line) - _solid(line)
    return (
        F.when((marks > 0) & (marks * 100 > _solid(line) * MAX_MARKS_PERCENT), "punctuation")
        .when((separators >= MIN_SEPARATORS) & (separators * MAX_SPACES_PER_SEPARATOR >= white), "navigation")
        .when(_boilerplate(line), "boilerplate")
        .when(~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (_solid(line) >= MIN_SHOUT), "shouting")
    )


def _repeat_words(d: DataFrame) -> DataFrame:
    """n_repeat_words from _words: words in three-word windows that the text has twice."""
    w = F.col("_words")
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
    d = d.withColumn("_hash", F.when(F.size(w) > 3, windows).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("_hash")) < F.size("_hash")
    d = d.withColumn("_sorted", F.when(some, F.sort_array("_hash")).otherwise(F.array().cast("array<bigint>")))
    s = F.col("_sorted")
    d = d.withColumn("_twice", F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
    many = F.size("_twice") > FEW
    d = d.withColumn("_pairs", F.when(many, F.sort_array(F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p, h, t = F.col("_pairs"), F.col("_hash"), F.col("_twice")
    in_pairs = F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"]))
    by_sort = F.sort_array(F.transform(in_pairs, lambda x: x["i"]))
    by_look = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(t, x), i)), lambda i: i.isNotNull())
    d = d.withColumn("_at", F.when(F.size(t) == 0, F.array().cast("array<int>")).when(many, by_sort).otherwise(by_look))
    a = F.col("_at")
    steps = F.transform(a, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(a, i + 1) - x, F.lit(3))))
    return d.withColumn("_repeat", F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x))


def _judged(docs: DataFrame, text: str) -> DataFrame:
    d = docs.withColumn("_text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    d = d.withColumn("_words", words(F.col("_text"))).withColumn("_lines", F.split("_text", "\n"))
    d = _repeat_words(d)
    solid = F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_solid", solid).withColumn("_failed", F.filter("_lines", lambda x: line_failure(x).isNotNull()))
    total = F.length(F.array_join("_words", ""))
    lost = F.aggregate(F.col("_failed"), F.lit(0).cast("long"), lambda acc, x: acc + _solid(x))
    d = d.withColumn("_n", F.size("_words").cast("long")).withColumn("_chars", total.cast("long")).withColumn("_lost", lost)
    failed = (F.col("_n") < MIN_WORDS) | (F.col("_repeat") * 100 > F.col("_n") * MAX_REPEAT_PERCENT)
    return d.withColumn("_base", failed).withColumn("_kept", ~failed & (F.col("_lost") * 100 <= F.col("_chars") * MAX_LOST_PERCENT))


def clean_lines(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """Kept documents without their failing lines, in their own columns."""
    # The input's columns go in one struct, so that none of theirs has the name of a working column.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("text"))
    # A verdict that isn't deterministic in form stays above the columns that it is made of;
    # pushed below them, the filter would repeat their expressions many times over.
    d = _judged(whole, "text").withColumn("_go", F.col("_kept") & (F.spark_partition_id() >= 0)).filter("_go")
    clean = F.when(F.size("_failed") > 0, F.array_join(F.filter("_lines", lambda x: line_failure(x).isNull()), "\n")).otherwise(F.col("text"))
    new = {text: clean} | ({n_chars: F.length(clean).cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return d.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Figures and verdict of every document."""
    d = _judged(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text")
    return d.select(
        "doc_id",
        F.col("_n").alias("n_words"),
        F.col("_chars").alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_solid") - F.size(F.array_distinct("_solid"))).cast("long").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        F.col("_base").alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.size("_failed").cast("long").alias("n_failed_lines"),
        F.col("_lost").alias("lost_chars"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
win AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT win.r, unnest([p, p + 1, p + 2]) AS q FROM win JOIN twice ON win.r = twice.r AND win.g = twice.g) GROUP BY r),
l AS (SELECT r, unnest(ls) AS x FROM d),
c AS (
  SELECT r, x, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS solid,
         length(x) - length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS white,
         length(x) - length(translate(x, '!"#$%&()*+/:;<=>?@[\]^_`{|}~', '')) AS marks,
         length(x) - length(translate(x, '|>»·•', '')) AS seps
  FROM l),
f AS (
  SELECT r, count(*) AS n, sum(solid) AS lost FROM c
  WHERE marks * 100 > solid * 15 OR (seps >= 2 AND seps * 6 >= white)
     OR regexp_matches(x, '(?i)(licensed under|all rights reserved|terms of (use|service)|privacy policy|accept (all )?cookies|enable javascript|subscribe to our|click here|sign up for)')
     OR (solid >= 10 AND regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}'))
  GROUP BY r),
s AS (SELECT r, count(*) - count(DISTINCT x) AS dup FROM c WHERE solid > 0 GROUP BY r),
o AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(s.dup, 0) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(f.n, 0) AS n_failed_lines, CAST(coalesce(f.lost, 0) AS BIGINT) AS lost_chars
  FROM d LEFT JOIN rep USING (r) LEFT JOIN f USING (r) LEFT JOIN s USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars * 100 <= word_chars * 30 AS kept
FROM o
"""
