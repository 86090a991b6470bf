"""Queries of the rule sets, over whole tables that stand in for documents and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantera.operators import quality, validation

from .extract import _tokens
from .registry import query
from .site import _values


@query("""
WITH d AS (SELECT doc_id, substr(text, 1, CAST(20 + doc_id % 60 AS INT)) AS t, substr(text, 10, CAST(doc_id % 200 AS INT)) AS x, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS ni FROM documents),
e AS (SELECT doc_id, trim(t, ' ') AS t, trim(x, ' ') AS x, coalesce(ni, false) AS ni FROM d)
SELECT doc_id, 'seo-title-missing' AS code FROM e WHERE NOT ni AND coalesce(t, '') = '' UNION ALL SELECT doc_id, 'seo-title-long' FROM e WHERE NOT ni AND length(t) > 60
UNION ALL SELECT doc_id, 'seo-description-missing' FROM e WHERE NOT ni AND coalesce(x, '') = '' UNION ALL SELECT doc_id, 'seo-description-length' FROM e WHERE NOT ni AND x <> '' AND length(x) NOT BETWEEN 70 AND 155
""")
def seo_fields(spark, t):
    k = F.col("doc_id")
    d = t("documents").select(k, F.substr("text", F.lit(1), (20 + k % 60).cast("int")).alias("t"), F.substr("text", F.lit(10), (k % 200).cast("int")).alias("x"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("ni"))
    return quality.issues(d, "doc_id", validation.seo_rules(F.col("t"), F.col("x"), F.col("ni")))


# (id, type, slug, language, date, opens, closes, closed, lat, lng, asset, alt, items)
DOCS = [
    ("a-uno", "a", "uno", "es", "2024-02-29", "09:00", "18:30", None, 38.5, -0.1, "img", "x", "1,2,3,4"),
    ("a-dos", "a", "Dos", "es", "2023-02-29", "9:00", "18:30", False, 38.5, None, None, None, "1,2,3"),
    ("b-tres", "a", "tres", None, "2024-2-01", None, None, True, 98.0, 0.0, "img", " ", "1,1,2,3"),
    ("a-cua-tro", "a", "cua-tro", "fr", None, "24:00", None, True, None, None, None, "alt", "1,2,3,4,5,6,7,8,9"),
    ("a-", "a", "", "en", "x", "00:00", "23:59", None, -90.0, 180.0, None, "", "1,2,3,4,5,6,7,8"),
    ("a--x", "a", "-x", "en", None, "10:00", "1:00", None, 0.0, -181.0, "i", None, ""),
]
NAMES = "id, type, slug, language, date, opens, closes, closed, lat, lng, asset, alt, items"
TIME = "^([01]\\d|2[0-3]):[0-5]\\d$"
TESTS = {
    "slug": "coalesce(trim(slug), '') = '' OR NOT regexp_matches(slug, '^[a-z0-9]+(?:-[a-z0-9]+)*$')",
    "id": "id IS DISTINCT FROM type || '-' || slug",
    "language": "coalesce(language NOT IN ('es', 'en'), true)",
    "date": "date IS NOT NULL AND (NOT regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') OR try_cast(date AS DATE) IS NULL)",
    "hours": f"NOT coalesce(closed, false) AND (NOT coalesce(regexp_matches(opens, '{TIME}'), false) OR NOT coalesce(regexp_matches(closes, '{TIME}'), false))",
    "closed-with-hours": "coalesce(closed, false) AND (opens IS NOT NULL OR closes IS NOT NULL)",
    "geopoint": "(lat IS NULL) <> (lng IS NULL) OR NOT coalesce(lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180, true)",
    "image-alt": "asset IS NOT NULL AND coalesce(trim(alt), '') = ''",
    "image-asset": "asset IS NULL AND coalesce(trim(alt), '') <> ''",
    "too-few": "len(xs) < 4",
    "too-many": "len(xs) > 8",
    "repeated": "len(list_distinct(xs)) < len(xs)",
}


@query(f"WITH d AS (SELECT *, string_split(items, ',') AS xs FROM {_values(DOCS, NAMES)}) " + " UNION ALL ".join(f"SELECT id, '{c}' AS code FROM d WHERE {test}" for c, test in TESTS.items()))
def document_rules(spark, t):
    kinds = {"closed": "boolean", "lat": "double", "lng": "double"}
    d = spark.createDataFrame(DOCS, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in NAMES.split(", ")))
    c = F.col
    rules = validation.identity_rules(c("id"), c("type"), c("slug"), c("language"), c("date")) | validation.nested_rules(c("opens"), c("closes"), c("closed"), c("lat"), c("lng"), c("asset"), c("alt")) | validation.list_rules(F.split("items", ","), 4, 8)
    return quality.issues(d, "id", rules)


FILES = [(1, "cc0", None), (2, "CC-BY-SA-3.0-es", None), (3, None, "CC BY 4.0"), (4, "cc-by-nc-4.0", None), (5, None, "Public domain"), (6, "pd-old", "x"), (7, "gfdl", "GFDL"), (8, "", " "), (9, None, "CC BY-ND 2.0"), (10, "cc-by-9.9", None), (11, None, "CC BY-SA 2.5 it"), (12, None, "dominio público")]
CODE, SHORT = "lower(trim(coalesce(code, '')))", "lower(trim(coalesce(short, '')))"


@query(rf"""
WITH f AS (SELECT id::BIGINT AS id, {CODE} AS c, {SHORT} AS s FROM (SELECT id, code, short FROM {_values(FILES, "id, code, short")} UNION ALL SELECT p_partkey + 1000, CASE WHEN p_type = 'LARGE' THEN 'CC-BY-SA-' || p_size // 10 || '.0' WHEN p_type = 'SMALL' THEN 'cc-by-nc-3.0' END, CASE WHEN p_type = 'PROMO' THEN 'CC BY ' || p_size // 10 || '.' || p_size % 10 WHEN p_type = 'ECONOMY' THEN p_name END FROM part)),
k AS (SELECT *, CASE WHEN regexp_matches(c, '^cc-(by(?:-sa)?)-(\d\.\d)(?:-[a-z]{{2,}})?$') THEN regexp_extract(c, '^cc-by(?:-sa)?-\d\.\d') WHEN regexp_matches(s, '^cc (by(?:-sa)?) (\d\.\d)(?: [a-z]{{2,}})?$') THEN 'cc-' || regexp_extract(s, '^cc (by(?:-sa)?) ', 1) || '-' || regexp_extract(s, '\d\.\d') END AS cc FROM f),
m AS (SELECT *, CASE WHEN c = 'cc0' OR s = 'cc0' THEN 'cc0' WHEN c = 'pd' OR starts_with(c, 'pd-') OR starts_with(s, 'public domain') OR s = 'dominio público' THEN 'public-domain' WHEN cc IN ({', '.join(repr(x) for x in validation.LICENCES)}) THEN cc END AS found,
  regexp_matches(c || ' ' || s, '\b(?:nc|nd)\b|-nc\b|-nd\b|noncommercial|noderivs') AS limited FROM k)
SELECT id, CASE WHEN c = '' AND s = '' THEN NULL WHEN limited THEN NULL ELSE found END AS licence, CASE WHEN c = '' AND s = '' THEN 'none' WHEN limited THEN 'limited' WHEN found IS NULL THEN 'unknown' END AS reason FROM m
""")
def image_licences(spark, t):
    tens, kind = (F.col("p_size") / 10).cast("int"), F.col("p_type")
    code = F.when(kind == "LARGE", F.concat(F.lit("CC-BY-SA-"), tens, F.lit(".0"))).when(kind == "SMALL", "cc-by-nc-3.0")
    short = F.when(kind == "PROMO", F.concat(F.lit("CC BY "), tens, F.lit("."), F.col("p_size") % 10)).when(kind == "ECONOMY", F.col("p_name"))
    f = spark.createDataFrame(FILES, "id bigint, code string, short string").unionByName(t("part").select((F.col("p_partkey") + 1000).alias("id"), code.alias("code"), short.alias("short")))
    return f.select("id", validation.licence(F.col("code"), F.col("short")).alias("l")).select("id", F.col("l.id").alias("licence"), "l.reason")


APPROVALS = [
    (1, "Ana", "2026-01-02", "Playa al sol", None, True, "lugar", "beach", "Beach"),
    (2, " ", "hoy", "", None, None, "lugar", "business", None),
    (3, "Ana", "2026-01-02", "Vista de Benidorm", "Calpe", False, "ambiental", "beach", "vista de  BENIDORM"),
    (4, "Ana", "2026-01-02", "Mesa", "en benidormo", False, "ambiental", "guide", None),
    (5, "Ana", None, "Mesa", None, True, "ambiental", "guide", "otra"),
]
# An approval for each order, as its attributes have it.
APPROVED_SQL = """SELECT o_orderkey + 10, CASE WHEN o_orderstatus <> 'P' THEN 'Ana' END, CASE WHEN o_totalprice > 100000 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '1-1-2020' END, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'Vista ' || o_orderpriority END, CASE WHEN o_custkey % 5 = 0 THEN 'en Calpe' END,
  CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END, CASE WHEN o_custkey % 3 = 0 THEN 'ambiental' ELSE 'lugar' END, CASE WHEN o_custkey % 7 = 0 THEN 'business' ELSE 'guide' END, 'vista  ' || CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE 'otra' END FROM orders"""
F0 = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
ATESTS = {
    "business": "kind = 'business'",
    "approved-by": "coalesce(trim(who), '') = ''",
    "approved-at": "NOT coalesce(regexp_matches(day, '^\\d{4}-\\d{2}-\\d{2}$'), false)",
    "alt": "coalesce(trim(alt), '') = ''",
    "verified": "verified IS NULL",
    "copied": f"coalesce(trim(alt), '') <> '' AND coalesce(trim(description), '') <> '' AND {F0.format('alt')} = {F0.format('description')}",
    "names-place": f"NOT verified AND (contains(' ' || {F0.format('concat_ws($$ $$, alt, caption)').replace('$$', chr(39))} || ' ', ' benidorm ') OR contains(' ' || {F0.format('concat_ws($$ $$, alt, caption)').replace('$$', chr(39))} || ' ', ' calpe '))",
    "ambient-verified": "verified AND use = 'ambiental'",
}


@query(f"WITH a AS (SELECT id::BIGINT AS id, who, day, alt, caption, verified, use, kind, description FROM {_values(APPROVALS, 'id, who, day, alt, caption, verified, use, kind, description')} UNION ALL {APPROVED_SQL}) " + " UNION ALL ".join(f"SELECT id, '{c}' AS code FROM a WHERE {x}" for c, x in ATESTS.items()))
def image_approvals(spark, t):
    c = F.col
    a = spark.createDataFrame(APPROVALS, "id bigint, who string, day string, alt string, caption string, verified boolean, use string, kind string, description string")
    key, level = c("o_custkey"), c("o_orderpriority")
    orders = t("orders").select(
        (c("o_orderkey") + 10).alias("id"), F.when(c("o_orderstatus") != "P", "Ana").alias("who"), F.when(c("o_totalprice") > 100000, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("1-1-2020").alias("day"), F.when(level == "5-LOW", "").otherwise(F.concat(F.lit("Vista "), level)).alias("alt"), F.when(key % 5 == 0, "en Calpe").alias("caption"),
        F.when(c("o_orderstatus") == "O", True).when(c("o_orderstatus") == "F", False).alias("verified"), F.when(key % 3 == 0, "ambiental").otherwise("lugar").alias("use"), F.when(key % 7 == 0, "business").otherwise("guide").alias("kind"), F.concat(F.lit("vista  "), F.when(key % 2 == 0, level).otherwise("otra")).alias("description"),
    )
    a = a.unionByName(orders)
    return quality.issues(a, "id", validation.approval_rules(c("who"), c("day"), c("alt"), c("caption"), c("verified"), c("use"), c("kind"), c("description"), ["Benidorm", "Calpe"]))


CATS = ", ".join(f"'{c}'" for c in validation.CATEGORIES)
COMP = ", ".join(f"'{c}'" for c in validation.COMPARATIVE)
EVIDENCE = f"""ev AS (SELECT s_nationkey AS topic, l_suppkey AS business, [{CATS}, 'other'][CAST((l_partkey + l_suppkey) % CASE WHEN l_suppkey % 4 = 0 THEN 3 ELSE 10 END AS INT) + 1] AS dimension, CASE WHEN s_nationkey % 5 = 0 THEN 'Ú no' ELSE l_returnflag END AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
bu AS (SELECT s_nationkey AS topic, s_suppkey AS business, s_suppkey % 29 = 0 AS closed, s_suppkey % 23 = 0 AS review FROM supplier)"""


def _evidence(t):
    names = F.array(*[F.lit(c) for c in (*validation.CATEGORIES, "other")])
    k = F.when(F.col("l_suppkey") % 4 == 0, 3).otherwise(10)
    e = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return e.select(F.col("s_nationkey").alias("topic"), F.col("l_suppkey").alias("business"), F.get(names, ((F.col("l_partkey") + F.col("l_suppkey")) % k).cast("int")).alias("dimension"), F.when(F.col("s_nationkey") % 5 == 0, "Ú no").otherwise(F.col("l_returnflag")).alias("value"))


def _businesses(t):
    k = F.col("s_suppkey")
    return t("supplier").select(F.col("s_nationkey").alias("topic"), k.alias("business"), (k % 29 == 0).alias("closed"), (k % 23 == 0).alias("review"))


@query(f"""
WITH {EVIDENCE}, e AS (SELECT * FROM ev WHERE dimension IN ({CATS})), per AS (SELECT topic, business, count(DISTINCT dimension) AS n, bool_or(dimension IN ({COMP})) AS c FROM e GROUP BY 1, 2),
a AS (SELECT topic, count(*) AS nb, count(*) FILTER (coalesce(n, 0) < 3) AS weak, count(*) FILTER (coalesce(c, false)) AS comp, count(*) FILTER (closed) AS closed, count(*) FILTER (review) AS review FROM bu LEFT JOIN per USING (topic, business) GROUP BY 1),
d AS (SELECT topic, count(*) AS covered, count(*) FILTER (b >= 2 AND v >= 2 AND dimension IN ({COMP})) AS differ FROM (SELECT topic, dimension, count(DISTINCT business) AS b, count(DISTINCT {F0.format('value')}) AS v FROM e GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT a.*, coalesce(covered, 0) AS covered, coalesce(differ, 0) AS differ FROM a LEFT JOIN d USING (topic))
SELECT topic, 'INELIGIBLE_OPERATIONAL_STATUS' AS code FROM j WHERE closed > 0 UNION ALL SELECT topic, 'OPERATIONAL_STATUS_REVIEW' FROM j WHERE review > 0 UNION ALL SELECT topic, 'MINIMUM_BUSINESSES' FROM j WHERE nb < 4
UNION ALL SELECT topic, 'INSUFFICIENT_EVIDENCE_COVERAGE' FROM j WHERE weak > 0 OR covered < 4 OR comp < 3 UNION ALL SELECT topic, 'LOW_COMPARATIVE_VALUE' FROM j WHERE differ < 3
""")
def data_gate(spark, t):
    return validation.data_gate(_evidence(t), _businesses(t))


@query(f"""
WITH {EVIDENCE}, dm AS (SELECT unnest([{CATS}]) AS dimension) SELECT topic, dimension, count(DISTINCT e.business) AS businesses, count(e.business) AS facts FROM (SELECT DISTINCT topic FROM bu) CROSS JOIN dm LEFT JOIN ev e USING (topic, dimension) GROUP BY 1, 2
""")
def evidence_coverage(spark, t):
    domain = spark.createDataFrame([(c,) for c in validation.CATEGORIES], "dimension string")
    return validation.coverage(_evidence(t), _businesses(t), domain)


@query(f"""
WITH l AS (SELECT doc_id AS doc, k AS path, x AS text FROM (SELECT doc_id, generate_subscripts(xs, 1) % 3 AS k, unnest(xs) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents))),
c AS (SELECT item_id AS doc, generate_subscripts(xs, 1) % 3 AS path, unnest(xs) AS claim FROM (SELECT item_id, string_split(text, '. ') AS xs FROM benchmark)),
h AS (SELECT DISTINCT doc, path FROM (SELECT doc, path, unnest({_tokens('text')}) AS w FROM l) JOIN (SELECT doc, path, unnest({_tokens('claim')}) AS w FROM c) USING (doc, path, w))
SELECT DISTINCT doc, path FROM l ANTI JOIN h USING (doc, path)
""")
def undeclared_claims(spark, t):
    lines = t("documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("k", "text")).select("doc", ((F.col("k") + 1) % 3).cast("bigint").alias("path"), "text")
    claims = t("benchmark").select(F.col("item_id").alias("doc"), F.posexplode(F.split("text", r"\. ")).alias("k", "claim")).select("doc", ((F.col("k") + 1) % 3).cast("bigint").alias("path"), "claim")
    return validation.undeclared(lines, claims)


# Blocks of made-up documents: alike across zones, alike within one, too short, and not alike enough.
ALIKE = "Terraza cubierta, arroces caldosos, paellas mixtas y mariscos frescos"
MADE = [(-1, "intro", ALIKE), (-1, "entry", ALIKE + " diarios"), (-2, "entry", ALIKE), (-2, "entry", ALIKE + " hoy"), (-3, "intro", "arroces caldosos"), (-3, "entry", "arroces caldosos"), (-4, "intro", ALIKE), (-4, "entry", "Terraza cubierta con vistas amplias, arroces secos y carnes")]
BLOCKS = f"b AS (SELECT doc, zone, list_distinct({_tokens('text')}) AS ts, len({_tokens('text')}) AS n FROM (SELECT conv_id AS doc, role AS zone, text FROM conversations UNION ALL SELECT doc, zone, text FROM {_values(MADE, 'doc, zone, text')}))"


@query(f"WITH {BLOCKS}, k AS (SELECT * FROM b WHERE n >= 6) SELECT DISTINCT x.doc FROM k x JOIN k y ON x.doc = y.doc AND x.zone < y.zone WHERE len(list_intersect(x.ts, y.ts)) >= 0.7 * len(list_distinct(list_concat(x.ts, y.ts))) - 1e-9")
def repeated_sections(spark, t):
    made = spark.createDataFrame(MADE, "doc bigint, zone string, text string")
    return validation.repeated_blocks(t("conversations").select(F.col("conv_id").alias("doc"), F.col("role").alias("zone"), "text").unionByName(made))


SAID = [(1, "Café 1,20 € y 1.20€"), (1, "Abre 9:00 - 12:00"), (2, "Menú 12 €, 12,00 €; 12 €."), (2, "9:00–12:00 y 9:00 - 12:00, 9:00-12:00"), (3, "3 €"), (4, None)]
FEATURED = [(1, 1.2), (3, 3.0), (4, 5.0), (4, 5.0)]


@query(rf"""
WITH t AS (SELECT doc::BIGINT AS doc, text FROM {_values(SAID, "doc, text")} UNION ALL SELECT l_orderkey + 10, 'Son ' || l_quantity::INT || ' € y ' || l_quantity::INT || ',00€ de ' || (l_linenumber + 8) || ':00 - 18:30' FROM lineitem), f AS (SELECT doc::BIGINT AS doc, price::DOUBLE AS price FROM {_values(FEATURED, "doc, price")} UNION ALL SELECT o_orderkey + 10, o_custkey % 50 FROM orders),
u AS (SELECT doc, 'price' AS kind, printf('%.2f', replace(p, ',', '.')::DOUBLE) AS value, 1 AS w FROM (SELECT doc, unnest(regexp_extract_all(text, '\b(\d{{1,3}}(?:[.,]\d{{1,2}})?)\s*€', 1)) AS p FROM t) UNION ALL SELECT doc, 'price', printf('%.2f', price), 2 FROM f
  UNION ALL SELECT doc, 'hours', regexp_replace(h, '\s*[–-]\s*', '–'), 1 FROM (SELECT doc, unnest(regexp_extract_all(text, '\b\d{{1,2}}:\d{{2}}\s*[–-]\s*\d{{1,2}}:\d{{2}}\b')) AS h FROM t))
SELECT doc, kind, value, sum(w)::BIGINT AS n FROM u GROUP BY 1, 2, 3 HAVING sum(w) > 2
""")
def repeated_facts(spark, t):
    n = F.col("l_quantity").cast("int")
    said = F.concat(F.lit("Son "), n, F.lit(" € y "), n, F.lit(",00€ de "), F.col("l_linenumber") + 8, F.lit(":00 - 18:30"))
    lines = spark.createDataFrame(SAID, "doc bigint, text string").unionByName(t("lineitem").select((F.col("l_orderkey") + 10).alias("doc"), said.alias("text")))
    featured = spark.createDataFrame(FEATURED, "doc bigint, price double").unionByName(t("orders").select((F.col("o_orderkey") + 10).alias("doc"), (F.col("o_custkey") % 50).cast("double").alias("price")))
    return validation.repetitions(lines, featured)


@query("""
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'insufficient' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'basic' END AS tier, CASE WHEN c_custkey % 2 = 0 THEN 'direct' ELSE 'potential' END AS origin, coalesce(n, 0) AS direct, coalesce(f, 0) AS enriched, c_mktsegment AS seg, c_nationkey AS nk FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey),
r AS (SELECT *, CASE WHEN seg = 'BUILDING' THEN 'unreachable' WHEN seg = 'MACHINERY' THEN 'no-official-website' END AS research FROM c),
s AS (SELECT *, CASE WHEN tier = 'insufficient' THEN 'quality' WHEN origin = 'direct' AND direct = 0 THEN 'brand-scope' WHEN origin = 'potential' AND enriched = 0 THEN coalesce(research, 'no-evidence') END AS reason FROM r)
SELECT id, CASE WHEN reason IS NULL THEN 'confirmed' ELSE 'rejected' END AS outcome, reason, CAST(least(12, direct * 3) + CASE tier WHEN 'rich' THEN 3 WHEN 'basic' THEN 2 ELSE 0 END + least(3, enriched) + CASE WHEN nk % 2 = 0 THEN 2 ELSE 0 END + least(2, nk) + least(3, nk % 5) AS BIGINT) AS score FROM s
""")
def confirmed_candidates(spark, t):
    o = t("orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("f"))
    c = t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    tier = F.when(F.col("c_acctbal") < 0, "insufficient").when(F.col("c_acctbal") > 5000, "rich").otherwise("basic")
    origin = F.when(F.col("c_custkey") % 2 == 0, "direct").otherwise("potential")
    research = F.when(F.col("c_mktsegment") == "BUILDING", "unreachable").when(F.col("c_mktsegment") == "MACHINERY", "no-official-website")
    direct, enriched, nk = F.coalesce("n", F.lit(0)), F.coalesce("f", F.lit(0)), F.col("c_nationkey")
    found = validation.confirmation(tier, origin, direct, enriched, research)
    score = validation.potential_score(direct, tier, enriched, nk % 2 == 0, nk, nk % 5)
    return c.select(F.col("c_custkey").alias("id"), found["outcome"].alias("outcome"), found["reason"].alias("reason"), score.cast("bigint").alias("score"))
