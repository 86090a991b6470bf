"""Queries over evidence: tiers, gates, rule checks, merges, promotion and regression."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cantera.functions.urls import domains, host
from cantera.operators import aggregates, classify, lifecycle, quality
from cantera.sources import sinks

from .registry import query

ORDERS = "(SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1)"


@query(f"""
WITH c AS (SELECT c_custkey, coalesce(trim(c_name) <> '', false) AS i, c_nationkey IS NOT NULL AS p, coalesce(n > 0, false) AS d1, coalesce(c_acctbal > 5000, false) AS d2, coalesce(c_mktsegment <> 'MACHINERY', false) AS w,
                  CAST(coalesce(n > 5, false) AS INT) + CAST(coalesce(most > 400000, false) AS INT) + CAST(coalesce(done > 2, false) AS INT) + CAST(coalesce(c_acctbal > 0, false) AS INT) AS score
           FROM customer LEFT JOIN {ORDERS} o ON o_custkey = c_custkey)
SELECT c_custkey, CASE WHEN NOT (i AND p AND (d1 OR d2)) THEN 'insufficient' WHEN w AND score >= 3 THEN 'rich' ELSE 'basic' END AS tier, CAST(score AS INT) AS score FROM c
""")
def quality_tier(spark, t):
    o = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    c = t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    yes = lambda x: F.coalesce(x, F.lit(False))
    found = quality.tier(
        yes(F.trim("c_name") != ""),
        F.col("c_nationkey").isNotNull(),
        [F.col("n") > 0, F.col("c_acctbal") > 5000],
        yes(F.col("c_mktsegment") != "MACHINERY"),
        [F.col("n") > 5, F.col("most") > 400000, F.col("done") > 2, F.col("c_acctbal") > 0],
    )
    return c.withColumn("t", found).select("c_custkey", "t.tier", "t.score")


RULES_SQL = """
SELECT o_orderkey, 'PRICE_RANGE' AS code FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 490000
UNION ALL SELECT o_orderkey, 'STATUS_PENDING' FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'PRIORITY_FORMAT' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z ]+$')
"""


def _order_issues(t):
    rules = {
        "PRICE_RANGE": ~F.col("o_totalprice").between(1000, 490000),
        "STATUS_PENDING": F.col("o_orderstatus") == "P",
        "PRIORITY_FORMAT": ~F.col("o_orderpriority").rlike("^[1-3]-[A-Z ]+$"),
    }
    return quality.issues(t("orders"), "o_orderkey", rules)


@query(RULES_SQL)
def rule_issues(spark, t):
    return _order_issues(t)


@query(f"""
SELECT o.o_orderkey, CASE max(CASE code WHEN 'PRICE_RANGE' THEN 2 WHEN 'STATUS_PENDING' THEN 1 WHEN 'PRIORITY_FORMAT' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARNING' ELSE 'PASS' END AS outcome
FROM orders o LEFT JOIN ({RULES_SQL}) i ON o.o_orderkey = i.o_orderkey GROUP BY 1
""")
def rule_outcome(spark, t):
    return quality.outcome(_order_issues(t), t("orders"), "o_orderkey", {"PRICE_RANGE": 2, "STATUS_PENDING": 1, "PRIORITY_FORMAT": 1})


@query("""
WITH e AS (SELECT p_brand, l_suppkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT p_brand, l_suppkey, count(DISTINCT p_type) AS kinds FROM e GROUP BY 1, 2),
k AS (SELECT p_brand, count(DISTINCT p_type) AS n_categories FROM e GROUP BY 1)
SELECT p.p_brand, count(*) AS n_entities, count(*) FILTER (kinds < 3) AS n_weak, any_value(n_categories) AS n_categories,
       count(*) >= 4 AND count(*) FILTER (kinds < 3) = 0 AND any_value(n_categories) >= 4 AS passed
FROM p JOIN k ON p.p_brand = k.p_brand GROUP BY 1
""")
def coverage_gate(spark, t):
    e = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return quality.coverage_gate(e, "p_brand", "l_suppkey", "p_type", {"entities": 4, "per_entity": 3, "categories": 4}).select("p_brand", "n_entities", "n_weak", "n_categories", "passed")


@query("""
WITH a AS (SELECT user_id, CAST(round(max(value)) AS BIGINT) AS v FROM events WHERE event_type = 'click' GROUP BY 1),
b AS (SELECT user_id, CAST(round(max(value)) AS BIGINT) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.v, b.v) AS value,
       CASE WHEN a.v IS NULL THEN 'view' WHEN b.v IS NULL THEN 'click' WHEN a.v = b.v THEN 'click,view' ELSE 'click' END AS sources
FROM a FULL JOIN b ON a.user_id = b.user_id
""")
def fact_merge(spark, t):
    fact = lambda kind: t("events").filter(F.col("event_type") == kind).groupBy("user_id").agg(F.struct(F.round(F.max("value")).cast("bigint").alias("value"), F.array(F.lit(kind)).alias("sources")).alias(kind))
    both = fact("click").join(fact("view"), "user_id", "full").withColumn("m", quality.merge_facts(F.col("click"), F.col("view")))
    return both.select("user_id", "m.value", F.array_join("m.sources", ",").alias("sources"))


STAGED = "SELECT o_orderkey AS k, o_totalprice AS v, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'WARNING' ELSE 'FAIL' END AS outcome FROM orders WHERE o_orderpriority <> '5-LOW'"
PUBLISHED = "SELECT o_orderkey AS k, o_totalprice / 2 AS v FROM orders WHERE o_orderstatus <> 'O' OR o_orderpriority = '5-LOW'"


@query(f"""
WITH s AS ({STAGED}), p AS ({PUBLISHED})
SELECT k, v FROM s WHERE outcome <> 'FAIL' UNION ALL SELECT k, v FROM p WHERE k NOT IN (SELECT k FROM s)
""")
def promotion(spark, t):
    status = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "WARNING").otherwise("FAIL")
    staged = t("orders").filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), status.alias("outcome"))
    published = t("orders").filter("o_orderstatus <> 'O' or o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 2).alias("v"))
    return sinks.promote(staged, published, "k")


@query(f"""
WITH s AS (SELECT k, v FROM ({STAGED})), p AS ({PUBLISHED})
SELECT 'replace' AS mode, k, v FROM s UNION ALL SELECT 'replace', k, v FROM p WHERE k NOT IN (SELECT k FROM s)
UNION ALL SELECT 'absent', k, v FROM p UNION ALL SELECT 'absent', k, v FROM s WHERE k NOT IN (SELECT k FROM p)
""")
def batch_upserts(spark, t):
    s = t("orders").filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    p = t("orders").filter("o_orderstatus <> 'O' or o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 2).alias("v"))
    return sinks.create_or_replace(p, s, "k").select(F.lit("replace").alias("mode"), "k", "v").unionByName(sinks.create_if_absent(p, s, "k").select(F.lit("absent").alias("mode"), "k", "v"))


@query("""
WITH s AS (SELECT c_name AS path, md5(c_mktsegment) AS h FROM customer WHERE c_acctbal >= 0 OR c_mktsegment = 'BUILDING'),
t AS (SELECT c_name AS path, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE md5(c_mktsegment) END AS h FROM customer WHERE c_acctbal < 6000),
o AS (SELECT c_name AS path FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))
SELECT coalesce(s.path, t.path) AS path, CASE WHEN s.h IS NULL THEN 'keep' WHEN t.h IS NULL THEN 'create' WHEN s.h = t.h THEN 'same' WHEN o.path IS NOT NULL THEN 'update' ELSE 'conflict' END AS action
FROM s FULL JOIN t ON s.path = t.path LEFT JOIN o ON o.path = coalesce(s.path, t.path)
""")
def artifact_sync(spark, t):
    c = t("customer").withColumn("path", F.col("c_name")).withColumn("hash", F.md5("c_mktsegment"))
    target = c.filter("c_acctbal < 6000").withColumn("hash", F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(F.col("hash")))
    return sinks.sync_state(c.filter("c_acctbal >= 0 or c_mktsegment = 'BUILDING'").select("path", "hash"), target.select("path", "hash"), c.filter("c_mktsegment in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')").select("path"))


@query("""
WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part),
x AS (SELECT * FROM a WHERE r <= 40), y AS (SELECT * FROM b WHERE r <= 40)
SELECT coalesce(x.p_partkey, y.p_partkey) AS p_partkey, CASE WHEN x.r IS NULL THEN 'added' WHEN y.r IS NULL THEN 'removed' WHEN x.r <> y.r THEN 'moved' ELSE 'same' END AS change
FROM x FULL JOIN y ON x.p_partkey = y.p_partkey
""")
def selection_regression(spark, t):
    def top(by):
        first = t("part").orderBy(F.desc(by), "p_partkey").limit(40)
        return first.select("p_partkey", F.row_number().over(Window.orderBy(F.desc(by), "p_partkey")).alias(f"r_{by}"))

    both = top("p_retailprice").join(top("p_size"), "p_partkey", "full")
    old, new = F.col("r_p_retailprice"), F.col("r_p_size")
    return both.select("p_partkey", F.when(old.isNull(), "added").when(new.isNull(), "removed").when(old != new, "moved").otherwise("same").alias("change"))


@query("""
SELECT o_orderpriority, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days FROM orders GROUP BY 1
""")
def date_ranges(spark, t):
    return t("orders").groupBy("o_orderpriority").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"), F.countDistinct(F.to_date("o_orderdate")).alias("n_days"))


@query("""
SELECT event_type, user_id, min(event_id) AS first, min(min(event_id)) OVER (PARTITION BY event_type) AS group_first FROM events GROUP BY 1, 2
""")
def first_seen_groups(spark, t):
    each = t("events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first"))
    # A row for each member: ordered by group_first and first, groups and members stand as first seen.
    groups = t("events").groupBy("event_type").agg(F.min("event_id").alias("group_first"))
    return each.join(groups, "event_type")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def log_tail(spark, t):
    return lifecycle.last_rows(t("events"), "event_id", 100).select("event_id", "event_type")


@query(r"""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS h FROM pages)
SELECT page_id, allowed FROM u JOIN (VALUES ('example.com'), ('example.org'), ('tionsh.example.net')) v(allowed) ON h = allowed OR ends_with(h, '.' || allowed)
""")
def allowed_hosts(spark, t):
    allowed = spark.createDataFrame([("example.com",), ("example.org",), ("tionsh.example.net",)], "allowed string")
    u = t("pages").select("page_id", F.explode(domains(host(F.col("url")))).alias("allowed"))
    return u.join(allowed, "allowed").select("page_id", "allowed")


@query("""
WITH a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS x FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT a.o_custkey, len(list_distinct(list_concat(a.x, b.x)))::INT AS n_union, len(list_intersect(a.x, b.x))::INT AS n_both, len(list_filter(a.x, lambda v: NOT list_contains(b.x, v)))::INT AS n_only,
       len(list_intersect(a.x, b.x)) = len(a.x) AND len(a.x) = len(b.x) AS equal
FROM a JOIN b ON a.o_custkey = b.o_custkey
""")
def array_sets(spark, t):
    kinds = lambda s, c: t("orders").filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias(c))
    both = kinds("F", "x").join(kinds("O", "y"), "o_custkey")
    return both.select("o_custkey", F.size(F.array_union("x", "y")).alias("n_union"), F.size(F.array_intersect("x", "y")).alias("n_both"), F.size(F.array_except("x", "y")).alias("n_only"), (F.col("x") == F.col("y")).alias("equal"))


@query("""
SELECT p_partkey, CASE WHEN p_type = 'PROMO' AND p_size < 10 THEN 'small promo' WHEN p_type = 'PROMO' THEN 'promo' WHEN contains(p_name, 'ring') THEN 'ring' ELSE 'other' END AS kind,
       50 + 5 * (CASE WHEN trim(p_name) <> '' THEN 1 ELSE 0 END) + 5 * (CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS priority
FROM part
""")
def ordered_classification(spark, t):
    kind = classify.first_rule([("small promo", (F.col("p_type") == "PROMO") & (F.col("p_size") < 10)), ("promo", F.col("p_type") == "PROMO"), ("ring", F.contains("p_name", F.lit("ring")))], "other")
    score = classify.priority(50, 5, [F.col("p_name"), F.when(F.col("p_size") > 25, "large")])
    return t("part").select("p_partkey", kind.alias("kind"), score.alias("priority"))


@query("""
SELECT tile, count(s_suppkey) AS n FROM (
  SELECT r * 4 + c AS tile, 38.5 + r * 0.025 AS s, -0.2 + c * 0.025 AS w, 38.5 + (r + 1) * 0.025 AS n, -0.2 + (c + 1) * 0.025 AS e FROM range(4) a(r), range(4) b(c)) t
LEFT JOIN (SELECT s_suppkey, 38.5 + (s_suppkey * 37 % 100) / 1000.0 + 0.0005 AS lat, -0.2 + (s_suppkey * 53 % 100) / 1000.0 + 0.0005 AS lng FROM supplier) p
ON lat >= s AND lat < n AND lng >= w AND lng < e GROUP BY 1
""")
def tile_counts(spark, t):
    k = F.col("s_suppkey")
    p = t("supplier").select((38.5 + (k * 37 % 100) / 1000.0 + 0.0005).alias("lat"), (-0.2 + (k * 53 % 100) / 1000.0 + 0.0005).alias("lng"))
    grid = classify.tiles(spark, 38.5, -0.2, 38.6, -0.1, 4)
    # A place's tile is computed, so that places and tiles meet in an equi-join.
    row, col = F.floor((F.col("lat") - 38.5) / 0.025), F.floor((F.col("lng") + 0.2) / 0.025)
    counts = p.filter(F.col("lat").between(38.5, 38.6) & F.col("lng").between(-0.2, -0.1)).groupBy((row * 4 + col).alias("tile")).agg(F.count("*").alias("n"))
    return grid.select("tile").join(counts, "tile", "left").select("tile", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
WITH d AS (SELECT user_id, event_type, value, json_extract_string(props, '$.k')::INT AS k FROM events),
u AS (SELECT DISTINCT user_id FROM d), f AS (SELECT unnest(['click', 'error', 'none']) AS key),
a AS (SELECT user_id, key, sum(n) AS n FROM (SELECT user_id, event_type AS key, 1 AS n FROM d UNION ALL SELECT user_id, key, 0 FROM u, f) GROUP BY 1, 2),
b AS (SELECT user_id, CASE WHEN k < 50 THEN 'low' ELSE 'high' END AS key, sum(round(value)) AS n FROM d GROUP BY 1, 2)
SELECT u.user_id, (SELECT string_agg(key || '=' || n::INT, ',' ORDER BY key) FROM a WHERE a.user_id = u.user_id) AS by_type, (SELECT string_agg(key || '=' || n::INT, ',' ORDER BY key) FROM b WHERE b.user_id = u.user_id) AS by_level FROM u
""")
def map_totals(spark, t):
    """Events and their values by user, as totals of two maps a row."""
    level = F.when(F.get_json_object("props", "$.k").cast("int") < 50, "low").otherwise("high")
    rows = t("events").select("user_id", F.create_map("event_type", F.lit(1.0)).alias("by_type"), F.create_map(level, F.round("value")).alias("by_level"))
    found = aggregates.map_totals(rows, ["user_id"], {"by_type": ["click", "error", "none"], "by_level": None})
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int"))), ",")
    return found.select("user_id", text("by_type").alias("by_type"), text("by_level").alias("by_level"))
