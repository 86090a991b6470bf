"""Queries of reports and lookups over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantera.functions import extract
from cantera.functions.urls import host, source_key
from cantera.operators import aggregates, reports

from .registry import query
from .site import _values


@query("""
SELECT o_orderstatus AS provider, sum(n)::BIGINT AS discovered, count(*) AS records, count(*) FILTER (n > 3) AS rich FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1
""")
def discovered_totals(spark, t):
    lists = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("sources"))
    return t("orders").join(lists, "o_orderkey").groupBy(F.col("o_orderstatus").alias("provider")).agg(F.sum(F.size("sources")).alias("discovered"), F.count("*").alias("records"), F.count_if(F.size("sources") > 3).alias("rich"))


@query("""
SELECT '{"l_linestatus":"' || l_linestatus || '","l_returnflag":"' || l_returnflag || '"}' AS object, max(l_orderkey * 8 + l_linenumber) AS last FROM lineitem GROUP BY 1
""")
def distinct_datasets(spark, t):
    return reports.distinct_objects(t("lineitem").withColumn("ord", F.col("l_orderkey") * 8 + F.col("l_linenumber")), "ord", ["l_returnflag", "l_linestatus"])


@query("""
WITH a AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)
SELECT user_id, CASE WHEN s <> 0 THEN s WHEN p <> 0 THEN p ELSE 0 END AS practical, s + p + e AS total FROM a
""")
def coverage_snapshot(spark, t):
    n = lambda k: F.count_if(F.col("event_type") == k)
    a = t("events").groupBy("user_id").agg(n("signup").alias("s"), n("purchase").alias("p"), n("error").alias("e"))
    return a.select("user_id", reports.first_nonzero(F.col("s"), F.col("p")).alias("practical"), (F.col("s") + F.col("p") + F.col("e")).alias("total"))


@query("""
WITH d AS (SELECT * FROM (VALUES (1, 'F', 'finished'), (2, 'O', 'open'), (3, 'P', 'pending'), (4, 'X', 'none')) AS v(pos, type, label)) SELECT pos, label, count(o_orderkey) AS n FROM d LEFT JOIN orders ON o_orderstatus = type GROUP BY 1, 2
""")
def import_summary(spark, t):
    domain = spark.createDataFrame([(1, "F", "finished"), (2, "O", "open"), (3, "P", "pending"), (4, "X", "none")], "pos int, type string, label string")
    counts = t("orders").groupBy(F.col("o_orderstatus").alias("type")).agg(F.count("*").alias("n"))
    return aggregates.zero_filled(counts, domain, "type").select("pos", "label", "n")


@query("SELECT p_brand AS attribute, min(p_size % 2) AS value FROM part GROUP BY 1 HAVING count(DISTINCT p_size % 2) = 1 UNION ALL SELECT p_name, min(p_type) FROM (SELECT 'all ' || p_brand AS p_name, 7 AS p_type FROM part) GROUP BY 1")
def uniform_values(spark, t):
    rows = t("part").select(F.col("p_brand").alias("attribute"), (F.col("p_size") % 2).alias("value"))
    return reports.uniform(rows.unionByName(t("part").select(F.concat(F.lit("all "), "p_brand").alias("attribute"), F.lit(7).alias("value"))), "attribute", "value")


@query("""
SELECT c.k, coalesce(o.v, -1) AS last FROM (SELECT c_custkey AS k FROM customer) c LEFT JOIN (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) o USING (k)
""")
def last_lookup(spark, t):
    o = reports.last_by(t("orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v")), "k", "o_orderkey")
    return t("customer").select(F.col("c_custkey").alias("k")).join(o.select("k", "v"), "k", "left").select("k", F.coalesce("v", F.lit(-1.0)).alias("last"))


MANUAL = [("b1", "prices", "No aceptan tarjetas"), ("b1", "prices", "Menú con tarjetas regalo"), ("b2", "services", "Sin terraza cubierta"), ("b2", "prices", "No hay terraza"), ("b3", "services", "no abre")]
PUBLIC = [("b1", "prices", "Aceptan tarjetas"), ("b1", "services", "No aceptan tarjetas"), ("b2", "services", "Terraza con sombra"), ("b2", "services", "No tiene terraza"), ("b3", "services", "abre hoy")]
NEGATED = r"(?i)\b(no|sin|nunca)\b"
LONG = "list_filter(string_split(trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4 AND w NOT IN (" + ", ".join(f"'{w}'" for w in extract.STOP_WORDS) + "))"


@query(f"""
SELECT a.k, a.dimension, a.text AS a_text, b.text AS b_text FROM (SELECT * FROM {_values(MANUAL, 'k, dimension, text')} UNION ALL SELECT 'p' || l_partkey, l_linestatus, 'Con ' || p_name || ' de ' || p_type FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R') a
JOIN (SELECT * FROM {_values(PUBLIC, 'k, dimension, text')} UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_size > 25 THEN 'O' ELSE 'F' END, CASE WHEN p_retailprice > 930 THEN 'No hay ' ELSE 'Hay ' END || p_name FROM part) b USING (k, dimension)
WHERE regexp_matches(a.text, '{NEGATED}') <> regexp_matches(b.text, '{NEGATED}') AND list_has_any({LONG.format('a.text')}, {LONG.format('b.text')})
""")
def source_conflicts(spark, t):
    a, b = (spark.createDataFrame(rows, "k string, dimension string, text string") for rows in (MANUAL, PUBLIC))
    part = t("part").withColumn("k", F.concat(F.lit("p"), "p_partkey"))
    lines = t("lineitem").where("l_returnflag = 'R'").join(part, F.col("l_partkey") == F.col("p_partkey"))
    a = a.unionByName(lines.select("k", F.col("l_linestatus").alias("dimension"), F.concat(F.lit("Con "), "p_name", F.lit(" de "), "p_type").alias("text")))
    b = b.unionByName(part.select("k", F.when(F.col("p_size") > 25, "O").otherwise("F").alias("dimension"), F.concat(F.when(F.col("p_retailprice") > 930, "No hay ").otherwise("Hay "), "p_name").alias("text")))
    return reports.conflict_pairs(a, b, ["k", "dimension"], "text", NEGATED)


@query("""
SELECT c_custkey AS id, c_nationkey AS k, c_mktsegment AS name, price FROM customer LEFT JOIN (SELECT s_nationkey, arg_min(s_acctbal, s_suppkey) AS price FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1) ON s_nationkey = c_nationkey AND c_mktsegment = 'BUILDING'
""")
def featured_prices(spark, t):
    items = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("name"))
    prices = t("supplier").select(F.col("s_nationkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, " Building!").otherwise("otra").alias("name"), F.col("s_suppkey").alias("ord"), F.col("s_acctbal").alias("price"))
    return reports.first_match(items, prices, ["k"], "name", "ord", "price")


@query(r"""
WITH u AS (SELECT page_id AS ord, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages),
k AS (SELECT ord, url, h, regexp_replace(h, '^(www|m)\.', '') AS key, regexp_extract(url, '^(https?)', 1) AS s FROM u)
SELECT key, arg_min(url, (CASE s WHEN 'https' THEN 0 ELSE 1 END, ord)) AS url, arg_min(h, (length(h), ord)) AS label, min(ord) AS position, CAST(DATE '2024-01-01' + CAST(max(ord % 90) AS INT) AS VARCHAR) AS latest FROM k GROUP BY 1
""")
def collapsed_sources(spark, t):
    u, h = F.col("url"), host(F.col("url"))
    rows = t("pages").select("url", h.alias("label"), F.col("page_id").alias("ord"), F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")).cast("string"), F.lit("T00:00")).alias("accessed"))
    key = F.regexp_replace(F.split_part(source_key(u), F.lit("/"), F.lit(1)), r"^m\.", "")
    return reports.collapsed_sources(rows, key, F.when(F.startswith(u, F.lit("https")), 0).otherwise(1), F.length("label"))


@query("""
WITH n AS (SELECT o_custkey AS k, o_orderdate AS d, o_orderkey AS url FROM orders WHERE o_orderstatus <> 'P')
SELECT c_custkey AS k, coalesce(string_agg(CAST(url AS VARCHAR), ',' ORDER BY d DESC, url), '') AS notes FROM customer LEFT JOIN n ON k = c_custkey GROUP BY 1
""")
def creator_notes(spark, t):
    notes = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("url"), "o_orderstatus")
    rows = reports.attached(t("customer").select(F.col("c_custkey").alias("k")), "k", notes, [-F.unix_micros(F.col("d").cast("timestamp")), F.col("url")], "url", "notes", F.col("o_orderstatus") != "P")
    return rows.select("k", F.array_join(F.transform("notes", lambda x: x.cast("string")), ",").alias("notes"))


@query("""
SELECT s_nationkey AS place, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, CASE WHEN s_acctbal > 0 THEN s_acctbal END NULLS LAST, s_suppkey) AS position FROM supplier
""")
def image_candidates(spark, t):
    rows = t("supplier").select(F.col("s_nationkey").alias("place"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("basis"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("metres"))
    return reports.ranked(rows, "place", [F.asc("basis"), F.asc_nulls_last("metres"), F.asc("id")]).select("place", "id", "position")


@query("""
WITH f AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS sector FROM customer WHERE contains(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')), '1') AND c_mktsegment = 'BUILDING')
SELECT id, name, (SELECT count(*) FROM f) AS total, CAST(ceil((SELECT count(*) FROM f) / 5.0) AS BIGINT) AS pages FROM f ORDER BY lower(name), id LIMIT 5 OFFSET 5
""")
def businesses_page(spark, t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"))
    found = reports.searched(rows, "1", ["name"]).filter("sector = 'BUILDING'")
    return reports.page(found, [F.lower("name"), F.col("id")], 2, 5).select("id", "name", "total", "pages")


@query("""
WITH e AS (SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS phone, arg_max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, o_orderkey) AS lat FROM orders GROUP BY 1), m AS (SELECT user_id AS id, max(event_type) AS tier FROM events GROUP BY 1)
SELECT c_custkey AS id, c_name AS name, array_to_string(list_filter([CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'osm:' || c_mktsegment END, 'web:' || phone], lambda x: x IS NOT NULL), ',') AS contacts, coalesce(lat, c_acctbal) AS lat, tier
FROM customer LEFT JOIN e ON e.id = c_custkey LEFT JOIN m ON m.id = c_custkey
""")
def business_detail(spark, t):
    o = t("orders")
    e = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("phone"), F.max_by("o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("lat"))
    m = t("events").groupBy(F.col("user_id").alias("id")).agg(F.max("event_type").alias("tier"))
    c = t("customer").withColumnRenamed("c_custkey", "id").join(e, "id", "left").join(m, "id", "left")
    contacts = F.array_compact(F.array(F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit("osm:"), "c_mktsegment")), F.concat(F.lit("web:"), "phone")))
    return c.select("id", F.col("c_name").alias("name"), F.array_join(contacts, ",").alias("contacts"), F.coalesce("lat", "c_acctbal").alias("lat"), "tier")


@query("""
WITH b AS (SELECT o_custkey AS id, max(o_totalprice) > 200000 AS r FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), a AS (SELECT o_custkey AS id, max(o_totalprice) > 200000 AS r FROM orders GROUP BY 1),
j AS (SELECT c_custkey AS id, CASE WHEN b.r THEN 'rich' WHEN NOT b.r THEN 'basic' ELSE 'insufficient' END AS before, CASE WHEN a.r THEN 'rich' WHEN NOT a.r THEN 'basic' ELSE 'insufficient' END AS after FROM customer LEFT JOIN b ON b.id = c_custkey LEFT JOIN a ON a.id = c_custkey),
t AS (SELECT unnest(['insufficient', 'basic', 'rich']) AS tier) SELECT x.tier AS before, y.tier AS after, count(id) AS n FROM t x CROSS JOIN t y LEFT JOIN j ON j.before = x.tier AND j.after = y.tier GROUP BY 1, 2
""")
def tier_report(spark, t):
    side = lambda d, c: d.groupBy(F.col("o_custkey").alias("id")).agg(F.when(F.max("o_totalprice") > 200000, "rich").otherwise("basic").alias(c))
    j = t("customer").select(F.col("c_custkey").alias("id")).join(side(t("orders").filter("o_orderstatus = 'F'"), "before"), "id", "left").join(side(t("orders"), "after"), "id", "left")
    n = j.groupBy(F.concat_ws(">", F.coalesce("before", F.lit("insufficient")), F.coalesce("after", F.lit("insufficient"))).alias("move")).agg(F.count("*").alias("n"))
    tiers = ("insufficient", "basic", "rich")
    domain = spark.createDataFrame([(f"{a}>{b}", a, b) for a in tiers for b in tiers], "move string, before string, after string")
    return aggregates.zero_filled(n, domain, "move").select("before", "after", "n")
