"""Queries of visit evidence: orders are visits, their lines checks, parts facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cantera.operators import visits

from .registry import query

VISIT_SQL = """
line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS nth FROM lineitem),
fact AS (SELECT p_partkey, p_type = 'PROMO' AS yes_no FROM part WHERE p_size > 10),
c AS (SELECT 'visit-' || l_orderkey AS ref, nth::INT AS nth, l_partkey, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'boolean' ELSE 'number' END AS kind, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'true' ELSE l_quantity::INT::VARCHAR END AS value, p_partkey IS NOT NULL AS known, coalesce(yes_no, false) AS yes_no, l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity::INT <> 7 AS other, l_tax, l_suppkey
  FROM line LEFT JOIN fact ON p_partkey = l_partkey),
k AS (SELECT *, known AND CASE WHEN kind = 'boolean' THEN yes_no ELSE NOT other END AS good FROM c),
claim AS (SELECT l_partkey, ref, kind, value, l_suppkey FROM c WHERE l_tax < 0.02),
vals AS (SELECT DISTINCT l_partkey, kind, value FROM claim)"""


def visit_tables(t):
    c = F.col
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    boolean = (c("l_linestatus") == "O") & (c("l_returnflag") == "N")
    n = c("l_quantity").cast("int").cast("string")
    quote = F.when(boolean, "abierto").when((c("l_returnflag") == "R") & (c("l_linestatus") == "F"), "Son 7  unidades").otherwise(F.concat(F.lit("Son "), n, F.lit(",00 unidades.")))
    rows = t("lineitem").select(F.concat(F.lit("visit-"), "l_orderkey").alias("ref"), at.cast("int").alias("nth"), F.lit("price").alias("category"), quote.alias("quote"), F.concat(F.lit("Nota: "), quote, F.lit(" Fin.")).alias("text"), F.concat(F.lit("part-"), "l_partkey").alias("fact"), F.when(boolean, "boolean").otherwise("number").alias("kind"), F.when(boolean, "true").otherwise(n).alias("value"), "l_tax", "l_suppkey")
    facts = t("part").where("p_size > 10").select(F.concat(F.lit("part-"), "p_partkey").alias("fact"), F.when(c("p_type") == "PROMO", visits.BOOLEAN).otherwise("uds").alias("unit"))
    claims = rows.where("l_tax < 0.02").select("fact", "ref", "kind", "value", "l_suppkey")
    return rows.drop("l_tax", "l_suppkey"), facts, claims


@query(f"""WITH {VISIT_SQL}
SELECT ref, nth, 'part-' || l_partkey AS fact, value, CASE WHEN NOT good THEN 'reject' WHEN EXISTS (SELECT 1 FROM claim q WHERE q.ref = k.ref AND q.l_partkey = k.l_partkey AND q.kind = k.kind AND q.value = k.value) THEN 'already there'
  WHEN nth > min(nth) FILTER (WHERE good) OVER (PARTITION BY ref, l_partkey, kind, value) THEN 'repeated' WHEN kind = 'boolean' THEN 'needs confirmation' ELSE 'append' END AS outcome,
  (SELECT count(*) FROM vals WHERE vals.l_partkey = k.l_partkey AND (vals.kind, vals.value) <> (k.kind, k.value)) AS others FROM k
""")
def visit_claims(spark, t):
    checks, facts, claims = visit_tables(t)
    return visits.plan_claims(checks, facts, claims).select("ref", "nth", "fact", "value", "outcome", "others")


@query(f"""WITH {VISIT_SQL},
moved AS (SELECT 'part-' || l_partkey AS fact, CASE WHEN l_suppkey % 2 = 0 THEN ref ELSE 'visit-x' || l_suppkey END AS ref, kind, CASE WHEN l_suppkey % 3 = 0 THEN value ELSE '99' END AS value, l_partkey FROM claim),
bad AS (SELECT *, CASE WHEN starts_with(ref, 'visit-x') THEN 'no-visit'
  WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.ref = moved.ref AND k.l_partkey = moved.l_partkey AND k.kind = moved.kind AND k.value = moved.value) THEN 'other-value'
  WHEN NOT (SELECT min_by(CASE WHEN k.kind = 'boolean' THEN yes_no ELSE NOT other END, nth) FROM k WHERE k.ref = moved.ref AND k.l_partkey = moved.l_partkey AND k.kind = moved.kind AND k.value = moved.value) THEN 'not-literal' END AS fault FROM moved)
SELECT fact, ref, value, fault FROM bad WHERE fault IS NOT NULL
""")
def visit_claim_faults(spark, t):
    """Claims of which some cite another visit or say another value than was noted, by their supplier."""
    checks, facts, claims = visit_tables(t)
    s = F.col("l_suppkey")
    moved = claims.select("fact", F.when(s % 2 == 0, F.col("ref")).otherwise(F.concat(F.lit("visit-x"), s)).alias("ref"), "kind", F.when(s % 3 == 0, F.col("value")).otherwise("99").alias("value"))
    return visits.claim_faults(moved, checks, facts)
