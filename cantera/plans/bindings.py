"""Queries of claims bound to facts, over all documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantera.operators import bindings

from .registry import query

WORDS = "list_distinct(list_filter(string_split(regexp_replace(trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g')), '\\bdiari[oa]s?\\b', 'dias', 'g'), ' '), lambda w: w <> ''))"


@query(f"""
WITH leaf AS (SELECT doc_id AS id, source, text FROM documents),
claim AS (SELECT doc_id AS id, [n_chars // 7, n_chars % 7] AS supported_by FROM documents WHERE lang = 'en'),
tw AS (SELECT id, unnest({WORDS.format('text')}) AS t FROM leaf), uw AS (SELECT item_id, unnest({WORDS.format('text')}) AS u FROM benchmark),
rel AS (SELECT t, u FROM (SELECT DISTINCT t FROM tw) JOIN (SELECT DISTINCT u FROM uw) ON (length(t) >= 3 OR regexp_full_match(t, '[0-9]+')) AND contains(u, t) OR length(u) >= 4 AND contains(t, u)),
first AS (SELECT u, item_id FROM uw QUALIFY row_number() OVER (PARTITION BY u ORDER BY item_id) <= 8),
word AS (SELECT t, item_id FROM (SELECT DISTINCT t, item_id FROM rel JOIN first USING (u)) QUALIFY row_number() OVER (PARTITION BY t ORDER BY item_id) <= 8),
found AS (SELECT id, list(item_id ORDER BY item_id)[1:8] AS f FROM (SELECT DISTINCT id, item_id FROM tw JOIN word USING (t)) GROUP BY id),
s AS (SELECT leaf.id, supported_by AS c, f, list_has_all((SELECT list(item_id) FROM benchmark), supported_by) AS valid FROM leaf LEFT JOIN claim USING (id) LEFT JOIN found USING (id))
SELECT id, array_to_string(CASE WHEN valid OR f IS NULL THEN c WHEN c IS NULL THEN f[1:6] ELSE f END, ',') AS supported_by,
  CASE WHEN valid THEN 'kept' WHEN c IS NULL AND f IS NOT NULL THEN 'completed' WHEN c IS NULL THEN 'unsupported' WHEN f IS NOT NULL THEN 'repaired' ELSE 'unmatched' END AS state FROM s
""")
def claim_bindings(spark, t):
    docs = t("documents").select(F.lit("all").alias("scope"), F.col("doc_id").alias("id"), "text", "lang", "n_chars")
    facts = t("benchmark").select(F.lit("all").alias("scope"), F.col("item_id").alias("ord"), F.col("item_id").alias("fact"), "text")
    claims = docs.where("lang = 'en'").select("scope", "id", F.array(F.expr("n_chars div 7"), F.col("n_chars") % 7).alias("supported_by"))
    found = bindings.completed_claims(docs.select("scope", "id", "text"), claims, facts)
    return found.select("id", F.array_join("supported_by", ",").alias("supported_by"), "state")
