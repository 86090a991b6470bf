"""The query of business checks: parts are businesses, whose pages are made of their attributes with the faults that these give."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantera.operators import business_qa

from .registry import query

PAGE_SQL = """
p AS (SELECT 'part-' || p_partkey AS id, p_name AS name, p_type, p_size AS size, p_retailprice AS price, p_brand AS brand, regexp_extract(p_brand, '(\\d+)', 1)::INT AS b FROM part),
c AS (SELECT *, CASE WHEN p_type = 'MEDIUM' THEN 'insufficient' ELSE 'basic' END AS tier FROM p),
k AS (SELECT * FROM c WHERE tier <> 'insufficient'),
d AS (SELECT * FROM k WHERE size <> 1)"""
# What a page says is a list of the fact's words, so its density is full; the title is the brand and the name.


def part_pages(t):
    c, lit = F.col, F.lit
    src = F.array(lit("s"))
    fact = lambda kind, value, sources=src: F.struct(lit(kind).alias("kind"), value.alias("value"), sources.alias("sources"))
    rows = t("part").withColumn("id", F.concat(lit("part-"), "p_partkey")).withColumn("b", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")).withColumn("tier", F.when(c("p_type") == "MEDIUM", "insufficient").otherwise("basic"))
    facts = F.create_map(
        lit("name"), fact("string", c("p_name")), lit("businessKind"), fact("string", lit("shop")), lit("address"), fact("string", c("p_brand")), lit("concept"), fact("string", lit("ferreteria")),
        lit("phone"), fact("string", F.when(c("p_size") % 5 == 0, c("p_size").cast("string")), F.when(c("p_size") == 10, F.array(lit("gone"))).otherwise(src)),
    )
    source = F.struct(lit("s").alias("key"), lit("table").alias("provider"), c("id").alias("identifier"), F.concat(lit("https://x.example/"), "id").alias("url"), lit("2026-01-02T00:00:00Z").alias("retrieved"), F.when(c("p_type") == "PROMO", "").otherwise("parts").alias("attribution"))
    enriched = rows.where("p_size <> 2").select("id", facts.alias("facts"), F.array(source).alias("sources"))
    body = F.array(F.struct(F.concat(lit("Concepto de ferreteria "), "id").alias("text"), lit("normal").alias("style"), lit(False).alias("list_item")))
    documents = rows.where("p_size <> 1").select(
        "id", c("p_name").alias("name"), lit("shop").alias("kind"), c("p_brand").alias("address"), F.when((c("p_size") % 5 == 0) & (c("b") < 20), c("p_size").cast("string")).alias("phone"), lit(None).cast("string").alias("website"),
        lit(None).cast("double").alias("lat"), lit(None).cast("double").alias("lng"), F.when(c("p_retailprice") > 905, "2026-01-02").otherwise("2026-01-01").alias("last_verified"), F.when(c("p_size") > 48, "").otherwise("ferreteria").alias("short"),
        body.alias("body"), F.concat("p_name", lit(" "), "p_brand", lit(" "), "p_size").alias("seo_title"), c("id").alias("seo_description"), F.array(F.concat(F.when(c("b") == 3, "http://").otherwise("https://"), lit("x.example/"), "id")).alias("source_urls"), F.when(c("p_type") == "LARGE", F.array(lit("rating"))).otherwise(F.slice(F.array(lit("a")), 1, 0)).alias("extra"),
    )
    return rows.select("id", "tier"), enriched, documents


@query(f"""
WITH {PAGE_SQL}, e AS (SELECT * FROM k WHERE size <> 2), w AS (SELECT * FROM d WHERE size <> 2)
SELECT id, 'SKIPPED' AS severity, 'INSUFFICIENT_FACTS' AS code, 'qualityTier' AS path FROM c WHERE tier = 'insufficient'
UNION ALL SELECT id, 'FAIL', 'missing-enrichment', '' FROM k WHERE size = 2
UNION ALL SELECT id, 'FAIL', 'fact-provenance', 'facts' FROM e WHERE size = 10 OR p_type = 'PROMO' UNION ALL SELECT id, 'FAIL', 'source-provenance', 'sources' FROM e WHERE p_type = 'PROMO'
UNION ALL SELECT id, 'FAIL', 'missing-document', 'document' FROM e WHERE size = 1
UNION ALL SELECT id, 'FAIL', 'source-integrity', 'sources' FROM w WHERE b = 3
UNION ALL SELECT id, 'FAIL', 'incomplete', 'shortDescription' FROM w WHERE size > 48
UNION ALL SELECT id, 'FAIL', 'factual-integrity', 'phone' FROM w WHERE size % 5 = 0 AND b >= 20 UNION ALL SELECT id, 'FAIL', 'factual-integrity', 'lastVerified' FROM w WHERE price <= 905
UNION ALL SELECT id, 'FAIL', 'unsupported-fact', 'rating' FROM w WHERE p_type = 'LARGE'
UNION ALL SELECT id, 'FAIL', 'duplicate-entity', 'name' FROM d WHERE (SELECT count(*) FROM d o WHERE o.name = d.name) > 1
UNION ALL SELECT id, 'FAIL', 'duplicate-seo-title', 'seo.metaTitle' FROM d WHERE (SELECT count(*) FROM d o WHERE o.name = d.name AND o.brand = d.brand AND o.size = d.size) > 1
""")
def business_issues(spark, t):
    """All codes but those of similar texts, which these pages, made from one mould, would all have."""
    found, _ = business_qa.inspect(*part_pages(t))
    return found.where("code <> 'similar-content'")
