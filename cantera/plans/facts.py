"""Queries over facts: parts as facts, their order lines as claims, orders as pages that cite them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantera.operators import facts

from .registry import query

CLASS = "CASE l_linenumber % 6 WHEN 0 THEN 'official-location' WHEN 1 THEN 'third-party' WHEN 2 THEN 'official-brand' WHEN 3 THEN 'open-data' WHEN 4 THEN 'manual-first-party' END"
CLAIMS = f"""
cl AS (SELECT l_partkey AS fact, l_orderkey * 8 + l_linenumber AS ord, 'string' AS kind, CASE WHEN l_partkey % 3 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN ' Uno  dos' ELSE 'uno dos ' END ELSE l_returnflag END AS value,
  {CLASS} AS source_class, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS retrieved FROM lineitem),
fa AS (SELECT p_partkey AS fact, p_partkey % 2 = 0 AS municipal, CASE WHEN p_partkey % 4 = 0 THEN (SELECT min(ord) FROM cl WHERE cl.fact = p_partkey) END AS chosen, CASE WHEN p_partkey % 8 = 0 THEN 'settled' END AS chosen_value,
  CASE WHEN p_partkey % 12 = 0 THEN '2030-01-01' WHEN p_partkey % 20 = 0 THEN 'soon' WHEN p_partkey % 4 = 0 THEN '1990-01-01' END AS reviewed FROM part)
"""
CLASSES = "['official-location', 'official-brand', 'manual-first-party', 'open-data', 'third-party']"


def _claims(t):
    n = F.col("l_linenumber") % 6
    kind = F.when(n == 0, "official-location").when(n == 1, "third-party").when(n == 2, "official-brand").when(n == 3, "open-data").when(n == 4, "manual-first-party")
    value = F.when(F.col("l_partkey") % 3 == 0, F.when(F.col("l_linenumber") % 2 == 0, " Uno  dos").otherwise("uno dos ")).otherwise(F.col("l_returnflag"))
    return t("lineitem").select(F.col("l_partkey").alias("fact"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.lit("string").alias("kind"), value.alias("value"), kind.alias("source_class"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("retrieved"))


def _facts(t):
    k = F.col("p_partkey")
    first = _claims(t).groupBy(F.col("fact").alias("_f")).agg(F.min("ord").alias("_o"))
    reviewed = F.when(k % 12 == 0, "2030-01-01").when(k % 20 == 0, "soon").when(k % 4 == 0, "1990-01-01")
    rows = t("part").join(first, k == F.col("_f"), "left")
    return rows.select(k.alias("fact"), (k % 2 == 0).alias("municipal"), F.when(k % 4 == 0, F.col("_o")).alias("chosen"), F.when(k % 8 == 0, "settled").alias("chosen_value"), reviewed.alias("reviewed"))


RESOLVED = f"""
k AS (SELECT *, kind || ':' || lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS vk, coalesce(source_class, 'third-party') AS class FROM cl),
b AS (SELECT fact, count(DISTINCT vk) AS n, max(retrieved[1:10]) AS latest, arg_min({{'v': value, 'c': class, 'r': retrieved}}, (list_position({CLASSES}, class), -epoch(retrieved::TIMESTAMP), ord)) AS best FROM k GROUP BY 1),
x AS (SELECT fa.*, n, CASE WHEN n > 1 THEN CASE WHEN regexp_matches(reviewed, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND reviewed >= latest THEN (SELECT {{'v': value, 'c': class, 'r': retrieved}} FROM k WHERE k.fact = fa.fact AND k.ord = chosen) END ELSE best END AS c FROM fa LEFT JOIN b ON fa.fact = b.fact),
res AS (SELECT fact, CASE WHEN n IS NULL THEN 'unknown' WHEN c IS NULL THEN 'conflict' WHEN CASE WHEN municipal THEN c.c = 'official-location' ELSE c.c IN ('official-location', 'official-brand', 'manual-first-party') END THEN 'confirmed' ELSE 'needs verification' END AS status,
  CASE WHEN n > 1 THEN coalesce(chosen_value, c.v) ELSE c.v END AS value, c.c AS source_class, c.r AS retrieved FROM x)
"""


@query(f"WITH {CLAIMS}, {RESOLVED} SELECT * FROM res")
def resolved_facts(spark, t):
    return facts.resolve(_facts(t), _claims(t))


CITED = "ci AS (SELECT l_orderkey AS page, CASE WHEN l_linenumber = 7 THEN -l_partkey ELSE l_partkey END AS fact, CASE WHEN l_linenumber % 2 = 0 THEN 'confirmed' ELSE 'conflict' END AS status, CASE WHEN l_discount > 0.09 THEN 'official-location' END AS source_class FROM lineitem)"


@query(f"""
WITH {CLAIMS}, {RESOLVED}, {CITED}, j AS (SELECT ci.page, ci.fact, ci.status AS s, ci.source_class AS c, res.* EXCLUDE (fact), res.fact AS known FROM ci LEFT JOIN res ON ci.fact = res.fact)
SELECT page, fact, 'missing-fact' AS code FROM j WHERE known IS NULL
UNION ALL SELECT page, fact, 'differs:status' FROM j WHERE known IS NOT NULL AND s IS DISTINCT FROM status
UNION ALL SELECT page, fact, 'differs:source_class' FROM j WHERE known IS NOT NULL AND c IS DISTINCT FROM source_class
""")
def citation_issues(spark, t):
    n = F.col("l_linenumber")
    cited = t("lineitem").select(F.col("l_orderkey").alias("page"), F.when(n == 7, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("fact"), F.when(n % 2 == 0, "confirmed").otherwise("conflict").alias("status"), F.when(F.col("l_discount") > 0.09, "official-location").alias("source_class"))
    return facts.citation_issues(cited, facts.resolve(_facts(t), _claims(t)), ["status", "source_class"])


@query("""
WITH c AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS fact, l_shipinstruct AS v FROM (SELECT *, l_returnflag || l_linestatus AS l_shipinstruct FROM lineitem))
SELECT DISTINCT page, fact, n_variants FROM c JOIN (SELECT fact, count(DISTINCT v) AS n_variants FROM c GROUP BY 1 HAVING count(DISTINCT v) > 1) USING (fact)
""")
def cross_page_conflicts(spark, t):
    c = t("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("fact"), F.concat("l_returnflag", "l_linestatus").alias("v"))
    return facts.cross_page_conflicts(c, F.col("v"))


@query("""
WITH s AS (SELECT user_id AS entity, CASE WHEN event_type IN ('click', 'view') THEN 'open' ELSE 'closed' END AS status, value > 5 AS accepted, CASE event_id % 3 WHEN 0 THEN 'official-location' WHEN 1 THEN 'manual-first-party' ELSE 'third-party' END AS c, ts::DATE AS d FROM events),
a AS (SELECT entity, count(*) AS n, count(*) FILTER (accepted) AS na, min(status) FILTER (accepted) AS a, max(status) FILTER (accepted) AS b, min(status) FILTER (t) AS lo, max(status) FILTER (t) AS hi
      FROM (SELECT *, accepted AND c <> 'third-party' AND DATE '2024-07-01' - d BETWEEN 0 AND 180 AS t FROM s) GROUP BY 1),
r AS (SELECT entity, CASE WHEN lo = hi THEN lo ELSE 'unknown' END AS status, list_filter([CASE WHEN lo <> hi THEN 'contradictory-current' END, CASE WHEN na = 0 THEN 'none-accepted' END, CASE WHEN na > 0 AND lo IS NULL THEN 'not-current' END, CASE WHEN a <> b THEN 'contradictory' END], lambda x: x IS NOT NULL) AS rs FROM a)
SELECT entity, status, status = 'unknown' OR len(rs) > 0 AS needs_verification, array_to_string(rs, ',') AS reasons FROM r
""")
def operational_status(spark, t):
    k = F.col("event_id") % 3
    s = t("events").select(
        F.col("user_id").alias("entity"),
        F.when(F.col("event_type").isin("click", "view"), "open").otherwise("closed").alias("status"),
        (F.col("value") > 5).alias("accepted"),
        F.when(k == 0, "official-location").when(k == 1, "manual-first-party").otherwise("third-party").alias("source_class"),
        F.date_format("ts", "yyyy-MM-dd").alias("observed"),
    )
    return facts.operational_status(s, "2024-07-01").withColumn("reasons", F.array_join("reasons", ","))


@query("""
WITH s AS (SELECT s_suppkey AS source, CASE s_suppkey % 4 WHEN 0 THEN 'official-website' WHEN 1 THEN 'manual' WHEN 2 THEN 'osm' ELSE 'x' END AS provider, CASE WHEN s_suppkey % 5 = 0 THEN 'official-brand' END AS c, CASE WHEN s_suppkey % 15 = 0 THEN 'establishment' END AS p FROM supplier),
i AS (SELECT source, coalesce(c, CASE provider WHEN 'official-website' THEN 'official-location' WHEN 'manual' THEN 'manual-first-party' WHEN 'osm' THEN 'open-data' ELSE 'third-party' END) AS source_class, p FROM s),
j AS (SELECT source, source_class, coalesce(p, CASE WHEN source_class = 'official-brand' THEN 'brand' ELSE 'establishment' END) AS claim_scope FROM i)
SELECT l_orderkey, l_linenumber, l_suppkey AS source, source_class FROM lineitem LEFT JOIN j ON l_suppkey = source WHERE coalesce(claim_scope, '') <> 'brand'
""")
def local_scope(spark, t):
    k = F.col("s_suppkey")
    provider = F.when(k % 4 == 0, "official-website").when(k % 4 == 1, "manual").when(k % 4 == 2, "osm").otherwise("x")
    scopes = t("supplier").select(k.alias("source"), facts.source_integrity(provider, F.when(k % 5 == 0, "official-brand"), F.when(k % 15 == 0, "establishment")).alias("i")).select("source", "i.*")
    rows = facts.local_sources(t("lineitem").withColumnRenamed("l_suppkey", "source"), scopes)
    return rows.join(scopes, "source", "left").select("l_orderkey", "l_linenumber", "source", "source_class")
