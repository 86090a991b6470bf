"""Queries of the stages of catalogue entries: orders are entries, their lines are events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantera.operators import stages

from .registry import query

STATUS = "['" + "', '".join(stages.ORDER) + "']"
EVENTS_SQL = f"""
e AS (SELECT l_orderkey AS entry, l_linenumber AS seq, CASE WHEN l_returnflag = 'A' THEN 'error' ELSE 'transition' END AS kind, CASE WHEN l_returnflag = 'A' THEN ['enrichment', 'generation', 'qa'][l_suppkey % 3 + 1] ELSE {STATUS}[l_partkey % 7 + 1] END AS status,
  l_discount > 0.07 AS force, l_shipdate AS at_, l_linestatus AS message FROM lineitem),
ev AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY seq) AS i, count(*) OVER (PARTITION BY entry) AS n FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY entry, seq ORDER BY kind, status, force, at_, message) = 1)),
s AS (
  SELECT DISTINCT entry, 0::BIGINT AS i, NULL::VARCHAR AS status, [NULL::TIMESTAMP, NULL, NULL, NULL, NULL, NULL, NULL] AS t, NULL::VARCHAR AS error_stage, NULL::VARCHAR AS error_message, NULL::TIMESTAMP AS error_at, NULL::INT AS seq FROM ev
  UNION ALL
  SELECT s.entry, ev.i, CASE WHEN kind = 'error' THEN 'error' WHEN force OR coalesce(list_position({STATUS}, s.status), 0) < list_position({STATUS}, ev.status) THEN ev.status ELSE s.status END,
    CASE WHEN kind = 'error' THEN t ELSE list_transform(t, lambda x, k: CASE WHEN k = list_position({STATUS}, ev.status) THEN CASE WHEN force OR x IS NULL THEN ev.at_ ELSE x END WHEN force AND k > list_position({STATUS}, ev.status) THEN NULL ELSE x END) END,
    CASE WHEN kind = 'error' THEN ev.status END, CASE WHEN kind = 'error' THEN ev.message END, CASE WHEN kind = 'error' THEN ev.at_ END, ev.seq
  FROM s JOIN ev ON ev.entry = s.entry AND ev.i = s.i + 1
), last AS (SELECT s.*, n FROM s JOIN (SELECT DISTINCT entry, n FROM ev) m ON m.entry = s.entry AND m.n = s.i)"""


def line_events(t):
    pick = lambda names, k: F.get(F.array(*[F.lit(x) for x in names]), k)
    error = F.col("l_returnflag") == "A"
    return t("lineitem").select(
        F.col("l_orderkey").alias("entry"), F.col("l_linenumber").cast("long").alias("seq"), F.when(error, "error").otherwise("transition").alias("kind"),
        F.when(error, pick(("enrichment", "generation", "qa"), F.col("l_suppkey") % 3)).otherwise(pick(stages.ORDER, F.col("l_partkey") % 7)).alias("status"),
        (F.col("l_discount") > 0.07).alias("force"), F.col("l_shipdate").alias("at"), F.col("l_linestatus").alias("message"),
    )


@query(f"WITH RECURSIVE {EVENTS_SQL} SELECT entry, status, {', '.join(f't[{k + 1}] AS {c}' for k, c in enumerate(stages.TIMES))}, error_stage, error_message, error_at, seq::BIGINT AS seq FROM last")
def stage_states(spark, t):
    return stages.replayed(line_events(t), "entry")


@query(f"""WITH RECURSIVE {EVENTS_SQL} SELECT entry, {', '.join(f"CASE WHEN status = 'error' THEN coalesce(error_stage = '{s}', false) ELSE t[{stages.ORDER.index(a) + 1}] IS NOT NULL AND t[{stages.ORDER.index(b) + 1}] IS NULL END AS {s}" for s, (a, b) in stages.STAGES.items())} FROM last""")
def runnable_stages(spark, t):
    return stages.replayed(line_events(t), "entry").select("entry", *[stages.can_run(s).alias(s) for s in stages.STAGES])
