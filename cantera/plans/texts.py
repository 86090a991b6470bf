"""Queries over texts and pages: selection, similarity, page audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cantera.functions.text import fold, html_to_text, tokens
from cantera.functions.urls import canonical_url, host, source_key
from cantera.operators import graph, pairs, selection

from .registry import query

# Fixed values of the flagship query: its topic's phrases.
TERMS = ["the", "of the", "de la", "que la", "in the", "und der", "die der"]
FOLD = "trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""
WITH f AS (SELECT doc_id, ' ' || {FOLD} || ' ' AS x, quality, source FROM documents LEFT JOIN labels USING (doc_id)),
h AS (SELECT doc_id, quality, source, list_filter({TERMS!r}, lambda t: contains(x, ' ' || t || ' ')) AS hits FROM f),
m AS (SELECT *, list_filter(hits, lambda t: len(list_filter(hits, lambda u: u <> t AND contains(' ' || u || ' ', ' ' || t || ' '))) = 0) AS terms FROM h),
s AS (SELECT doc_id, terms, CAST(least(60, len(terms) * 20) AS DOUBLE) AS relevance,
             CASE WHEN quality IS NOT NULL THEN 10.0 ELSE 0.0 END::DOUBLE + CASE WHEN source IS NOT NULL THEN 5.0 ELSE 0.0 END::DOUBLE AS coverage FROM m),
r AS (SELECT *, relevance + coverage AS score, row_number() OVER (PARTITION BY len(terms) > 0 ORDER BY relevance + coverage DESC, relevance DESC, coverage DESC, doc_id) AS rn FROM s)
SELECT doc_id, len(terms)::BIGINT AS n_terms, score, CASE WHEN len(terms) > 0 AND rn <= 25 THEN rn END AS rank,
       CASE WHEN len(terms) = 0 THEN 'no match' WHEN rn <= 25 THEN 'selected' ELSE 'over limit' END AS outcome
FROM r
""")
def topic_selection(spark, t):
    docs = t("documents").select("doc_id", "text", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    found = selection.select_topic(docs, "doc_id", "text", TERMS, {"quality": 10.0, "source": 5.0}, 25)
    return found.select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), "score", "rank", "outcome")


@query(f"SELECT doc_id, md5({FOLD}) AS folded, CAST(length({FOLD}) AS BIGINT) AS n FROM documents")
def fold_text(spark, t):
    return t("documents").select("doc_id", F.md5(fold(F.col("text"))).alias("folded"), F.length(fold(F.col("text"))).cast("bigint").alias("n"))


TOKENS = f"list_distinct(list_filter(string_split({FOLD}, ' '), lambda w: length(w) >= 4 OR regexp_matches(w, '[0-9]')))"


@query(f"""
WITH c AS (SELECT doc_id AS id, {TOKENS} AS ts FROM documents), i AS (SELECT item_id AS id, {TOKENS} AS ts FROM benchmark),
e AS (SELECT id, len(ts) AS n, unnest(ts) AS w FROM c WHERE len(ts) > 0), f AS (SELECT id, len(ts) AS n, unnest(ts) AS w FROM i WHERE len(ts) > 0),
p AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k FROM e x JOIN f y ON x.w = y.w GROUP BY 1, 2)
SELECT a, b, round(k / (na + nb - k), 6) AS jaccard FROM p WHERE k / (na + nb - k) >= 0.15
""")
def jaccard_pairs(spark, t):
    sets = lambda d, k: d.select(F.col(k).alias("key"), tokens(F.col("text")).alias("tokens"))
    return pairs.jaccard_pairs(sets(t("documents"), "doc_id"), sets(t("benchmark"), "item_id"), 0.15).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""
WITH d AS (SELECT doc_id AS id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split({FOLD}, ' ')) AS w FROM documents) WHERE length(w) >= 4 GROUP BY 1, 2),
i AS (SELECT item_id AS id, w, count(*) AS n FROM (SELECT item_id, unnest(string_split({FOLD}, ' ')) AS w FROM benchmark) WHERE length(w) >= 4 GROUP BY 1, 2),
nd AS (SELECT id, sqrt(sum(n * n)) AS s FROM d GROUP BY 1), ni AS (SELECT id, sqrt(sum(n * n)) AS s FROM i GROUP BY 1),
p AS (SELECT d.id AS a, i.id AS b, sum(d.n * i.n) AS dot FROM d JOIN i ON d.w = i.w GROUP BY 1, 2)
SELECT a, b, round(dot / (nd.s * ni.s), 6) AS cosine FROM p JOIN nd ON nd.id = a JOIN ni ON ni.id = b WHERE dot / (nd.s * ni.s) >= 0.4
""")
def tf_cosine_pairs(spark, t):
    counts = lambda d, k: d.select(F.col(k).alias("key"), F.explode_outer(F.split(fold(F.col("text")), " ")).alias("token")).filter(F.length("token") >= 4).groupBy("key", "token").agg(F.count("*").alias("n"))
    return pairs.cosine_pairs(counts(t("documents"), "doc_id"), counts(t("benchmark"), "item_id"), 0.4).withColumn("cosine", F.round("cosine", 6))


@query(f"""
WITH i AS (SELECT item_id AS claim, {TOKENS} AS ts FROM benchmark), c AS (SELECT doc_id AS id, {TOKENS} AS ts FROM documents),
e AS (SELECT claim, unnest(ts) AS w FROM i), f AS (SELECT id, unnest(ts) AS w FROM c), s AS (SELECT claim, count(DISTINCT id) AS n FROM e JOIN f USING (w) GROUP BY 1)
SELECT claim, coalesce(n, 0) AS n_support FROM i LEFT JOIN s USING (claim)
""")
def claim_support(spark, t):
    claims = t("benchmark").select(F.col("item_id").alias("key"), tokens(F.col("text")).alias("tokens"))
    facts = t("documents").select(F.col("doc_id").alias("key"), tokens(F.col("text")).alias("tokens"))
    return pairs.claim_support(claims, facts)


CLEAN = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{0}[^>]*>(.*?)</{0}>', 1), '<[^>]*>', '', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"


@query(rf"""
SELECT page_id, {CLEAN.format("title")} AS title, {CLEAN.format("h1")} AS h1, len(regexp_extract_all(html, '(?i)<h1[ >]'))::BIGINT AS n_h1,
       len(regexp_extract_all(html, '(?i)<a\s[^>]*href='))::BIGINT AS n_links, regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1) AS lang,
       CASE WHEN regexp_matches(html, '(?i)<meta[^>]*http-equiv="?refresh') THEN 'redirect' WHEN regexp_matches(html, '(?i)<meta[^>]*name="?robots"?[^>]*noindex') THEN 'noindex' ELSE 'indexable' END AS page_type
FROM pages
""")
def page_fields(spark, t):
    return graph.page_fields(t("pages")).select("page_id", "title", "h1", "n_h1", "n_links", "lang", "page_type")


@query(rf"""
WITH v AS (SELECT page_id, {CLEAN.format("title")} AS value FROM pages)
SELECT page_id, value, n, first FROM (SELECT *, count(*) OVER (PARTITION BY value) AS n, min(page_id) OVER (PARTITION BY value) AS first FROM v WHERE value <> '') WHERE n > 1
""")
def duplicate_titles(spark, t):
    return graph.duplicate_groups(graph.page_fields(t("pages")), "page_id", F.col("title"))


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', ' ', 'g'), '(?is)<template\b[^>]*>.*?</template>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS x FROM a)
SELECT page_id, length(x)::BIGINT AS n, md5(x) AS text_md5 FROM b
""")
def html_text(spark, t):
    x = html_to_text(F.col("html"))
    return t("pages").select("page_id", F.length(x).cast("bigint").alias("n"), F.md5(x).alias("text_md5"))


@query(r"""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS p,
                  list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|fbclid|gclid|ref)='))) AS q FROM pages)
SELECT page_id, s || '://' || h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical, h AS host,
       regexp_replace(h, '^www\.', '') || regexp_replace(CASE WHEN regexp_matches(p, '^/(es|en|fr|de)(/|$)') THEN substr(p, 4) ELSE p END, '/+$', '') AS source_key
FROM u
""")
def canonical_urls(spark, t):
    u = F.col("url")
    return t("pages").select("page_id", canonical_url(u).alias("canonical"), host(u).alias("host"), source_key(u).alias("source_key"))


@query(r"""
WITH d AS (SELECT doc_id, lang, source, regexp_extract(text, '[A-Za-zÀ-ÿ]+', 0) AS title FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, lang, source, title, row_number() OVER (PARTITION BY lang, source ORDER BY title COLLATE es, title, doc_id)::INT AS place FROM d WHERE title <> ''
""")
def hub_listing(spark, t):
    """Every document's place in the listing of its language and source, by its first word in Spanish order (ñ after n, accents apart)."""
    docs = t("documents").where("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", "lang", "source", F.regexp_extract("text", r"[A-Za-zÀ-ÿ]+", 0).alias("title")).where("title <> ''")
    return docs.withColumn("place", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.collate("title", "es"), "title", "doc_id")))
