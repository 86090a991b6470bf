"""The named document queries, over stand-ins: customers as businesses, suppliers as comparisons, parts as guides, nations as beaches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cantera.operators import documents as d

from .registry import query

BUSINESS = """b AS (SELECT 'business-' || c_custkey AS id, c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 17 > 0 THEN 'b-' || c_custkey END AS slug, ['restaurant', 'bar', 'pub', 'cafe', 'hotel'][CAST(c_custkey % 5 AS INT) + 1] AS kind,
  CASE WHEN c_custkey % 7 = 0 THEN 'en' ELSE 'es' END AS language, r_name AS area, n_name AS category, c_mktsegment AS segment, c_acctbal > 5000 AS recommended, CASE WHEN c_custkey % 10 = 0 THEN true END AS no_index
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
COMPARISON = """c AS (SELECT s_suppkey AS k, s_name AS title, CASE WHEN s_suppkey % 11 > 0 THEN 'c-' || s_suppkey END AS slug, CASE WHEN s_suppkey % 3 > 0 THEN 'donde-comer' ELSE 'otro' END AS category, CASE WHEN s_suppkey % 5 = 0 THEN 'en' ELSE 'es' END AS language, s_nationkey AS author FROM supplier),
en AS (SELECT l_suppkey AS comparison, l_orderkey AS pos, o_custkey AS business FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1)"""
GUIDE = """g AS (SELECT p_partkey AS k, p_name AS title, CASE WHEN p_partkey % 13 > 0 THEN 'g-' || p_partkey END AS slug, ['informationPractical', 'thingsToDo', 'other'][p_size % 3 + 1] AS section, CASE WHEN p_partkey % 4 = 0 THEN 'en' ELSE 'es' END AS language,
  CAST(DATE '2024-01-01' + CAST(p_partkey % 300 AS INT) AS VARCHAR) AS published, p_brand AS kicker, p_retailprice AS price FROM part),
w AS (SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey % 6 > 0 THEN 'playa-' || n_nationkey END AS slug, n_regionkey AS area, n_nationkey % 2 = 0 AS flag FROM nation)"""
HREF = "CASE section WHEN 'informationPractical' THEN '/informacion-practica/' WHEN 'thingsToDo' THEN '/que-hacer/' ELSE '/guias/' END || slug || '/'"


def _business(t):
    k = F.col("c_custkey")
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    kinds = F.array(*[F.lit(x) for x in ("restaurant", "bar", "pub", "cafe", "hotel")])
    return rows.select(
        F.concat(F.lit("business-"), k).alias("id"),
        k.alias("k"),
        F.col("c_name").alias("name"),
        F.when(k % 17 > 0, F.concat(F.lit("b-"), k)).alias("slug"),
        F.get(kinds, (k % 5).cast("int")).alias("kind"),
        F.when(k % 7 == 0, "en").otherwise("es").alias("language"),
        F.col("r_name").alias("area"),
        F.col("n_name").alias("category"),
        F.col("c_mktsegment").alias("segment"),
        (F.col("c_acctbal") > 5000).alias("recommended"),
        F.when(k % 10 == 0, True).alias("no_index"),
    )


def _comparison(t):
    k = F.col("s_suppkey")
    return t("supplier").select(k.alias("k"), F.col("s_name").alias("title"), F.when(k % 11 > 0, F.concat(F.lit("c-"), k)).alias("slug"), F.when(k % 3 > 0, "donde-comer").otherwise("otro").alias("category"), F.when(k % 5 == 0, "en").otherwise("es").alias("language"), F.col("s_nationkey").alias("author"))


def _entries(t):
    return t("lineitem").filter("l_linenumber = 1").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("comparison"), F.col("l_orderkey").alias("pos"), F.col("o_custkey").alias("business"))


def _guide(t):
    k = F.col("p_partkey")
    sections = F.array(*[F.lit(x) for x in ("informationPractical", "thingsToDo", "other")])
    return t("part").select(
        k.alias("k"),
        F.col("p_name").alias("title"),
        F.when(k % 13 > 0, F.concat(F.lit("g-"), k)).alias("slug"),
        F.get(sections, F.col("p_size") % 3).alias("section"),
        F.when(k % 4 == 0, "en").otherwise("es").alias("language"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")).cast("string").alias("published"),
        F.col("p_brand").alias("kicker"),
        F.col("p_retailprice").alias("price"),
    )


def _beach(t):
    k = F.col("n_nationkey")
    return t("nation").select(k.alias("k"), F.col("n_name").alias("name"), F.when(k % 6 > 0, F.concat(F.lit("playa-"), k)).alias("slug"), F.col("n_regionkey").alias("area"), (k % 2 == 0).alias("flag"))


def _href(section="section", slug="slug"):
    base = F.when(F.col(section) == "informationPractical", "/informacion-practica/").when(F.col(section) == "thingsToDo", "/que-hacer/").otherwise("/guias/")
    return F.concat(base, slug, F.lit("/"))


@query(f"""
WITH {BUSINESS}, {GUIDE}, r AS (SELECT *, row_number() OVER (ORDER BY published DESC, k) AS pos FROM g WHERE language = 'es')
SELECT 'recent' AS part, pos, title, {HREF} AS href, kicker FROM r WHERE pos <= 3
UNION ALL SELECT 'recommendations', k, name, '/restaurantes/' || slug || '/', category FROM b WHERE recommended AND language = 'es'
""")
def home_page(spark, t):
    order = [F.desc("published"), F.asc("k")]
    recent = d.filtered(_guide(t), {"language": "es"}, order, 3)
    recent = recent.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select(F.lit("recent").alias("part"), "pos", "title", _href().alias("href"), "kicker")
    best = d.filtered(_business(t), {"language": "es", "recommended": True}, []).select(F.lit("recommendations").alias("part"), F.col("k").alias("pos"), F.col("name").alias("title"), F.concat(F.lit("/restaurantes/"), "slug", F.lit("/")).alias("href"), F.col("category").alias("kicker"))
    return recent.unionByName(best)


@query(f"""
WITH {BUSINESS}, {COMPARISON}, {GUIDE}
SELECT 'restaurant' AS kind, slug FROM b WHERE language = 'es' AND kind = 'restaurant' AND slug IS NOT NULL
UNION ALL SELECT 'comparison', slug FROM c WHERE language = 'es' AND category = 'donde-comer' AND slug IS NOT NULL
UNION ALL SELECT section, slug FROM g WHERE language = 'es' AND section <> 'other' AND slug IS NOT NULL UNION ALL SELECT 'beach', slug FROM w WHERE slug IS NOT NULL
""")
def slug_lists(spark, t):
    r = d.listed(_business(t)).filter("kind = 'restaurant'").select(F.lit("restaurant").alias("kind"), "slug")
    c = d.listed(_comparison(t)).filter("category = 'donde-comer'").select(F.lit("comparison").alias("kind"), "slug")
    g = d.listed(_guide(t)).filter("section <> 'other'").select(F.col("section").alias("kind"), "slug")
    return r.unionByName(c).unionByName(g).unionByName(_beach(t).filter("slug is not null").select(F.lit("beach").alias("kind"), "slug"))


@query(f"""
WITH {BUSINESS}, {COMPARISON}
SELECT b.id, b.name, '/restaurantes/' || b.slug || '/' AS href, area, category || ',' || segment AS categories, 'Sobre ' || name || '|' || coalesce(segment, '') AS description, CASE WHEN k % 3 = 0 THEN 'Cerrado' ELSE '09:00–' || (12 + k % 10) || ':00' END AS hours,
  coalesce((SELECT string_agg(DISTINCT '/donde-comer/' || c.slug || '/', ',' ORDER BY '/donde-comer/' || c.slug || '/') FROM en JOIN c ON en.comparison = c.k WHERE en.business = b.k), '') AS comparisons
FROM b WHERE language = 'es' AND kind = 'restaurant' AND slug IS NOT NULL
""")
def restaurant_details(spark, t):
    b = d.listed(_business(t)).filter("kind = 'restaurant'")
    seen = d.references(_entries(t), "comparison", [F.array("business")]).join(_comparison(t).select(F.col("k").alias("src"), F.concat(F.lit("/donde-comer/"), "slug", F.lit("/")).alias("h")), "src").filter("h is not null")
    seen = seen.groupBy(F.col("dst").alias("k")).agg(F.array_join(F.array_sort(F.collect_set("h")), ",").alias("comparisons"))
    child = lambda *xs: F.array(*[F.struct(x.alias("text")) for x in xs])
    block = lambda kind, kids: F.struct(F.lit(kind).alias("type"), F.lit("normal").alias("style"), kids.alias("children"))
    body = F.array(block("block", child(F.lit("Sobre "), F.col("name"))), block("image", child(F.lit("x"))), block("block", child(F.col("segment"), F.lit(None).cast("string"))))
    hours = F.when(F.col("k") % 3 == 0, "Cerrado").otherwise(F.concat(F.lit("09:00–"), 12 + F.col("k") % 10, F.lit(":00")))
    rows = b.join(seen, "k", "left")
    return rows.select("id", "name", F.concat(F.lit("/restaurantes/"), "slug", F.lit("/")).alias("href"), "area", F.concat_ws(",", "category", "segment").alias("categories"), F.array_join(F.transform(d.body_text(body), lambda x: x["text"]), "|").alias("description"), hours.alias("hours"), F.coalesce("comparisons", F.lit("")).alias("comparisons"))


@query(f"""
WITH {BUSINESS}, {COMPARISON}
SELECT c.slug, c.title, '/donde-comer/' || c.slug || '/' AS href, coalesce(n_name, 'David') AS author, string_agg(b.name, ',' ORDER BY pos, business) AS entries, count(*) AS n FROM c LEFT JOIN nation ON author = n_nationkey JOIN en ON en.comparison = c.k JOIN b ON b.k = en.business
WHERE c.language = 'es' AND c.category = 'donde-comer' AND c.slug IS NOT NULL GROUP BY 1, 2, 3, 4
""")
def comparison_details(spark, t):
    c = d.listed(_comparison(t)).filter("category = 'donde-comer'").join(t("nation").select(F.col("n_nationkey").alias("author"), F.col("n_name").alias("author_name")), "author", "left")
    e = _entries(t).join(_business(t).select(F.col("k").alias("business"), "name"), "business").groupBy(F.col("comparison").alias("k")).agg(F.array_sort(F.collect_list(F.struct("pos", "business", "name"))).alias("e"))
    return c.join(e, "k").select("slug", "title", F.concat(F.lit("/donde-comer/"), "slug", F.lit("/")).alias("href"), F.coalesce("author_name", F.lit("David")).alias("author"), F.array_join(F.transform("e", lambda x: x["name"]), ",").alias("entries"), F.size("e").cast("bigint").alias("n"))


LINKS = "lk AS (SELECT k AS guide, CASE WHEN k % 3 = 0 THEN 'guide-' || (k + 1) WHEN k % 3 = 1 THEN 'beach-' || (k % 25) ELSE 'none' END AS target FROM g), tg AS (SELECT 'guide-' || k AS target, title, CASE section WHEN 'thingsToDo' THEN '/que-hacer/' ELSE '/informacion-practica/' END || slug || '/' AS href FROM g WHERE slug IS NOT NULL UNION ALL SELECT 'beach-' || k, name, '/playas/' || slug || '/' FROM w WHERE slug IS NOT NULL)"


@query(f"""
WITH {GUIDE}, {LINKS}
SELECT section, row_number() OVER (PARTITION BY section ORDER BY published, g.title, g.k) AS pos, g.slug, {HREF.replace("slug", "g.slug")} AS href, published, tg.title AS link_title, tg.href AS link
FROM g LEFT JOIN lk ON lk.guide = g.k LEFT JOIN tg ON tg.target = lk.target WHERE language = 'es' AND section <> 'other' AND g.slug IS NOT NULL
""")
def guide_pages(spark, t):
    g, k = _guide(t), F.col("k")
    target = F.when(k % 3 == 0, F.concat(F.lit("guide-"), k + 1)).when(k % 3 == 1, F.concat(F.lit("beach-"), k % 25)).otherwise("none")
    guides = g.filter("slug is not null").withColumn("ref", F.concat(F.lit("guide-"), "k"))
    beaches = _beach(t).filter("slug is not null").withColumn("ref", F.concat(F.lit("beach-"), "k"))
    path = F.concat(F.when(F.col("section") == "thingsToDo", "/que-hacer/").otherwise("/informacion-practica/"), "slug", F.lit("/"))
    links = d.deref_any(g.select(k.alias("_g"), target.alias("ref")), "ref", [(guides, "ref", {"link_title": F.col("title"), "link": path}), (beaches, "ref", {"link_title": F.col("name"), "link": F.concat(F.lit("/playas/"), "slug", F.lit("/"))})]).drop("ref")
    rows = d.listed(g).filter("section <> 'other'").join(links, k == F.col("_g"), "left")
    pos = F.row_number().over(Window.partitionBy("section").orderBy("published", "title", "k"))
    return rows.select("section", pos.cast("bigint").alias("pos"), "slug", _href().alias("href"), "published", "link_title", "link")


@query(f"""
WITH {GUIDE} SELECT w.slug, w.name, r_name AS area, '/playas/' || w.slug || '/' AS href, count(l_partkey) AS n_facts, max(CAST(l_shipdate AS DATE)) AS latest, o.name AS contrast
FROM w LEFT JOIN region ON w.area = r_regionkey LEFT JOIN supplier ON s_nationkey = w.k LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN w o ON o.k = w.k + 1 AND o.slug IS NOT NULL WHERE w.slug IS NOT NULL GROUP BY 1, 2, 3, 4, 7
""")
def beach_pages(spark, t):
    w = _beach(t).filter("slug is not null")
    facts = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_facts"), F.max(F.col("l_shipdate").cast("date")).alias("latest"))
    rows = w.join(facts, "k", "left").join(t("region").select(F.col("r_regionkey").alias("area"), F.col("r_name").alias("area_name")), "area", "left").join(w.select((F.col("k") - 1).alias("k"), F.col("name").alias("contrast")), "k", "left")
    return rows.select("slug", "name", F.col("area_name").alias("area"), F.concat(F.lit("/playas/"), "slug", F.lit("/")).alias("href"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"), "latest", "contrast")


STORE = "st AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'drafts.' ELSE '' END || 'business-' || (c_custkey % 900) AS id, 'business' AS type FROM customer UNION ALL SELECT 'comparison-' || s_suppkey, 'comparison' FROM supplier)"


def _store(t):
    k = F.col("c_custkey")
    b = t("customer").select(F.concat(F.when(k % 3 == 0, "drafts.").otherwise(""), F.lit("business-"), k % 900).alias("id"), F.lit("business").alias("type"))
    return b.unionByName(t("supplier").select(F.concat(F.lit("comparison-"), "s_suppkey").alias("id"), F.lit("comparison").alias("type")))


@query(f"""
WITH {STORE}, wanted AS (SELECT 'business-' || o_custkey AS id FROM orders GROUP BY 1),
s AS (SELECT regexp_replace(id, '^drafts\\.', '') AS base, type, starts_with(id, 'drafts.') AS d FROM st)
SELECT base AS id, min(type) AS type, bool_or(d) AS draft, bool_or(NOT d) AS published FROM s WHERE base IN (SELECT id FROM wanted) GROUP BY 1
""")
def import_state(spark, t):
    wanted = t("orders").select(F.concat(F.lit("business-"), "o_custkey").alias("_w")).distinct()
    s = _store(t)
    return d.remote_state(s.join(wanted, d.base_id(F.col("id")) == F.col("_w"), "left_semi"))


@query(f"""
WITH {STORE}, r AS (SELECT l_orderkey AS src, CASE l_linenumber % 4 WHEN 0 THEN 'image-' || l_partkey WHEN 1 THEN 'business-' || l_suppkey WHEN 2 THEN 'comparison-' || (l_suppkey + 3) ELSE 'nothing-' || l_suppkey END AS dst FROM lineitem), o AS (SELECT DISTINCT id, type FROM st WHERE NOT starts_with(id, 'drafts.'))
SELECT src, dst, CASE WHEN id IS NULL THEN 'missing' ELSE 'type' END AS code FROM r LEFT JOIN o ON dst = id WHERE NOT starts_with(dst, 'image-') AND (id IS NULL OR type <> 'business')
""")
def reference_integrity(spark, t):
    n, s = F.col("l_linenumber") % 4, F.col("l_suppkey")
    dst = F.when(n == 0, F.concat(F.lit("image-"), "l_partkey")).when(n == 1, F.concat(F.lit("business-"), s)).when(n == 2, F.concat(F.lit("comparison-"), s + 3)).otherwise(F.concat(F.lit("nothing-"), s))
    refs = t("lineitem").select(F.col("l_orderkey").alias("src"), dst.alias("dst"), F.array(F.lit("business")).alias("allowed"))
    return d.reference_issues(refs, d.published(_store(t)).distinct())


@query(f"""
WITH {BUSINESS}, {GUIDE}, x AS (SELECT '/restaurantes/' || slug || '/' AS route, '/donde-comer/' AS hub FROM b WHERE language = 'es' AND slug IS NOT NULL AND kind = 'restaurant' UNION ALL SELECT '/playas/' || slug || '/', '/playas/' FROM w WHERE slug IS NOT NULL UNION ALL SELECT '/nada/' || slug || '/', '/nada/' FROM g WHERE section = 'nowhere')
SELECT '/' AS route UNION SELECT '/autor/' UNION SELECT route FROM x UNION SELECT hub FROM x
""")
def route_registry(spark, t):
    static = spark.createDataFrame([("/",), ("/autor/",)], "route string")
    path = lambda base: lambda slug: F.concat(F.lit(base), slug, F.lit("/"))
    r = d.listed(_business(t)).filter("kind = 'restaurant'")
    return d.routes(static, [(r, path("/restaurantes/"), "/donde-comer/"), (_beach(t).filter("slug is not null"), path("/playas/"), "/playas/"), (_guide(t).filter("section = 'nowhere'"), path("/nada/"), "/nada/")])


@query("""
WITH p AS (SELECT o_orderkey AS topic, CASE WHEN o_orderkey % 4 = 0 THEN 'PASS' END AS report, CASE WHEN o_orderstatus = 'F' THEN 'completed' END AS artifact, CASE WHEN o_totalprice > 200000 THEN 'FAIL' END AS overall, CASE WHEN o_orderpriority = '1-URGENT' THEN 'completed' END AS inferred FROM orders)
SELECT topic, coalesce(report, artifact, overall, inferred, 'not-run') AS state, CASE WHEN report IS NOT NULL THEN 'topic report' WHEN artifact IS NOT NULL THEN 'artifact' WHEN overall IS NOT NULL THEN 'report' WHEN inferred IS NOT NULL THEN 'published' ELSE 'none' END AS origin,
  CASE WHEN coalesce(report, artifact, overall, inferred, 'not-run') NOT IN ('PASS', 'WARNING', 'completed') THEN 'select' WHEN coalesce(artifact, 'not-run') NOT IN ('PASS', 'WARNING', 'completed') THEN 'enrich' END AS next FROM p
""")
def phase_states(spark, t):
    o = t("orders")
    sources = [("topic report", F.when(F.col("o_orderkey") % 4 == 0, "PASS")), ("artifact", F.when(F.col("o_orderstatus") == "F", "completed")), ("report", F.when(F.col("o_totalprice") > 200000, "FAIL")), ("published", F.when(F.col("o_orderpriority") == "1-URGENT", "completed"))]
    o = o.withColumn("s", d.phase_state(sources))
    later = F.coalesce(sources[1][1], F.lit("not-run"))
    return o.select(F.col("o_orderkey").alias("topic"), "s.state", "s.origin", d.next_phase([("select", F.col("s.state")), ("enrich", later)]).alias("next"))


@query("""
WITH e AS (SELECT user_id AS id, event_id AS ord, CASE event_type WHEN 'signup' THEN 'import' WHEN 'error' THEN 'dismiss' WHEN 'click' THEN 'approve' WHEN 'view' THEN 'undismiss' ELSE 'withdraw' END AS action FROM events),
n AS (SELECT id, action, row_number() OVER (PARTITION BY id ORDER BY ord) AS i, count(*) OVER (PARTITION BY id) AS m FROM e),
r AS (WITH RECURSIVE s(id, i, state) AS (SELECT DISTINCT id, 0::BIGINT, 'pending' FROM e UNION ALL SELECT s.id, n.i, CASE WHEN action = 'approve' AND state IN ('pending', 'withdrawn') THEN 'approved' WHEN action = 'dismiss' AND state IN ('pending', 'withdrawn') THEN 'dismissed' WHEN action = 'undismiss' AND state = 'dismissed' THEN 'pending'
   WHEN action = 'withdraw' AND state = 'approved' THEN 'withdrawn' WHEN action = 'import' AND state = 'approved' THEN 'imported' ELSE state END FROM s JOIN n ON n.id = s.id AND n.i = s.i + 1) SELECT * FROM s)
SELECT r.id, arg_max(state, i) AS state FROM r GROUP BY 1
""")
def image_decisions(spark, t):
    k = F.col("event_type")
    action = F.when(k == "signup", "import").when(k == "error", "dismiss").when(k == "click", "approve").when(k == "view", "undismiss").otherwise("withdraw")
    return d.current_decisions(t("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), action.alias("action")))


@query("""
WITH o AS (SELECT o_custkey AS id, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), n AS (SELECT o_custkey AS id, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), x AS (SELECT DISTINCT user_id AS id FROM events)
SELECT id, v FROM n UNION ALL SELECT id, v FROM o WHERE id IN (SELECT id FROM x) AND id NOT IN (SELECT id FROM n)
""")
def kept_candidates(spark, t):
    side = lambda s: t("orders").filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("v"))
    return d.decided(side("F"), side("O"), "id", t("events").select(F.col("user_id").alias("id")))
