"""Rule sets: dictionaries from issue codes to column conditions, for ``quality.issues``, and checks that need joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.functions.dates import strict_date
from cantera.functions.extract import claim_tokens
from cantera.functions.text import contains_phrase, fold, once
from cantera.sources.store import stored

SEO_TITLE_MAX, SEO_DESCRIPTION_MIN, SEO_DESCRIPTION_MAX = 60, 70, 155
REPEATED_BLOCK, REPEATED_TOKENS = 0.7, 6
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
# The categories of evidence, and those that tell businesses apart.
CATEGORIES = ("cuisine", "specialties", "featuredItems", "prices", "services", "location", "practical", "distinctive", "limitations")
COMPARATIVE = ("specialties", "featuredItems", "prices", "services", "location", "practical", "limitations")
# Licences that may be used; others, and those without commercial use or derivatives, may not.
LICENCES = ("cc0", "public-domain", "cc-by-2.0", "cc-by-2.5", "cc-by-3.0", "cc-by-4.0", "cc-by-sa-2.0", "cc-by-sa-2.5", "cc-by-sa-3.0", "cc-by-sa-4.0")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def seo_rules(title: Column, description: Column, no_index: Column) -> dict[str, Column]:
    """Pages that may not be indexed are free of them; lengths are in code points."""
    shown = ~F.coalesce(no_index, F.lit(False))
    n = F.length(F.trim(description))
    return {
        "seo-title-missing": shown & blank(title),
        "seo-title-long": shown & (F.length(F.trim(title)) > SEO_TITLE_MAX),
        "seo-description-missing": shown & blank(description),
        "seo-description-length": shown & ~blank(description) & ~n.between(SEO_DESCRIPTION_MIN, SEO_DESCRIPTION_MAX),
    }


def identity_rules(doc_id: Column, kind: Column, slug: Column, language: Column, date: Column) -> dict[str, Column]:
    return {
        "slug": blank(slug) | ~slug.rlike(SLUG),
        "id": ~doc_id.eqNullSafe(F.concat(kind, F.lit("-"), slug)),
        "language": ~F.coalesce(language.isin("es", "en"), F.lit(False)),
        "date": date.isNotNull() & strict_date(date).isNull(),
    }


def nested_rules(opens: Column, closes: Column, closed: Column, lat: Column, lng: Column, asset: Column, alt: Column) -> dict[str, Column]:
    time = r"^([01]\d|2[0-3]):[0-5]\d$"
    bad = lambda c: ~F.coalesce(c.rlike(time), F.lit(False))
    return {
        "hours": ~F.coalesce(closed, F.lit(False)) & (bad(opens) | bad(closes)),
        "closed-with-hours": F.coalesce(closed, F.lit(False)) & (opens.isNotNull() | closes.isNotNull()),
        "geopoint": (lat.isNull() != lng.isNull()) | ~F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(True)),
        "image-alt": asset.isNotNull() & blank(alt),
        "image-asset": asset.isNull() & ~blank(alt),
    }


def list_rules(items: Column, least: int, most: int) -> dict[str, Column]:
    return {"too-few": F.size(items) < least, "too-many": F.size(items) > most, "repeated": F.size(F.array_distinct(items)) < F.size(items)}


def order_mismatch(given: Column, expected: Column) -> Column:
    """Places (from 0) at which two lists differ, missing ones included."""
    n = F.greatest(F.size(given), F.size(expected))
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ~F.get(given, i).eqNullSafe(F.get(expected, i)))


def licence(code: Column, short: Column) -> Column:
    """(id, reason): the base licence of a file, or why it can't be used; national ports count as their base."""
    c, s = F.lower(F.trim(F.coalesce(code, F.lit("")))), F.lower(F.trim(F.coalesce(short, F.lit(""))))
    limited = F.concat_ws(" ", c, s).rlike(r"\b(?:nc|nd)\b|-nc\b|-nd\b|noncommercial|noderivs")
    kind = F.when(c.rlike(r"^cc-(by(?:-sa)?)-(\d\.\d)(?:-[a-z]{2,})?$"), F.regexp_replace(c, r"^(cc-by(?:-sa)?-\d\.\d).*$", "$1")).when(s.rlike(r"^cc (by(?:-sa)?) (\d\.\d)(?: [a-z]{2,})?$"), F.regexp_replace(s, r"^cc (by(?:-sa)?) (\d\.\d).*$", "cc-$1-$2"))
    found = F.when((c == "cc0") | (s == "cc0"), "cc0").when((c == "pd") | F.startswith(c, F.lit("pd-")) | F.startswith(s, F.lit("public domain")) | (s == "dominio público"), "public-domain").when(kind.isin(*LICENCES), kind)
    reason = F.when((c == "") & (s == ""), "none").when(limited, "limited").when(found.isNull(), "unknown")
    return F.struct(F.when(reason.isNull(), found).alias("id"), reason.alias("reason"))


def approval_rules(approved_by: Column, approved_at: Column, alt: Column, caption: Column, verified: Column, use: Column, kind: Column, description: Column, places: list[str]) -> dict[str, Column]:
    """Rules of an approved stock image; one that isn't verified may name no place."""
    text = fold(F.concat_ws(" ", alt, caption))
    named = F.lit(False)
    for p in places:
        named = named | contains_phrase(text, fold(F.lit(p)))
    return {
        "business": kind == "business",
        "approved-by": blank(approved_by),
        "approved-at": ~F.coalesce(approved_at.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)),
        "alt": blank(alt),
        "verified": verified.isNull(),
        "copied": ~blank(alt) & ~blank(description) & (fold(alt) == fold(description)),
        "names-place": (verified == F.lit(False)) & named,
        "ambient-verified": verified & (use == "ambiental"),
    }


def coverage(evidence: DataFrame, topics: DataFrame, domain: DataFrame) -> DataFrame:
    """(topic, dimension, businesses, facts) for every dimension of the domain, from evidence (topic, business, dimension, value)."""
    found = evidence.groupBy("topic", "dimension").agg(F.countDistinct("business").alias("businesses"), F.count("*").alias("facts"))
    all_ = topics.select("topic").distinct().crossJoin(F.broadcast(domain.select("dimension")))  # a few fixed dimensions
    return all_.join(found, ["topic", "dimension"], "left").select("topic", "dimension", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("businesses", "facts")])


def data_gate(evidence: DataFrame, businesses: DataFrame) -> DataFrame:
    """(topic, code): what keeps a topic from being compared, from businesses (topic, business, closed, review) and evidence (topic, business, dimension, value).

    At least 4 businesses, 3 dimensions for each of them, 4 dimensions over all, 3 businesses
    with comparative evidence and 3 dimensions with two businesses and two values; none
    closed. A status to review only warns.
    """
    e = evidence.filter(F.col("dimension").isin(*CATEGORIES))
    per = e.groupBy("topic", "business").agg(F.countDistinct("dimension").alias("n"), F.bool_or(F.col("dimension").isin(*COMPARATIVE)).alias("comparative"))
    each = businesses.join(per, ["topic", "business"], "left").groupBy("topic").agg(
        F.count("*").alias("n_businesses"),
        F.count_if(F.coalesce("n", F.lit(0)) < 3).alias("weak"),
        F.count_if(F.coalesce("comparative", F.lit(False))).alias("comparative"),
        F.count_if(F.coalesce("closed", F.lit(False))).alias("closed"),
        F.count_if(F.coalesce("review", F.lit(False))).alias("review"),
    )
    dims = e.groupBy("topic", "dimension").agg(F.countDistinct("business").alias("b"), F.countDistinct(fold(F.col("value"))).alias("v"))
    dims = dims.groupBy("topic").agg(F.count("*").alias("covered"), F.count_if((F.col("b") >= 2) & (F.col("v") >= 2) & F.col("dimension").isin(*COMPARATIVE)).alias("differ"))
    both = each.join(dims, "topic", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    codes = [
        ("INELIGIBLE_OPERATIONAL_STATUS", F.col("closed") > 0),
        ("OPERATIONAL_STATUS_REVIEW", F.col("review") > 0),
        ("MINIMUM_BUSINESSES", F.col("n_businesses") < 4),
        ("INSUFFICIENT_EVIDENCE_COVERAGE", (F.col("weak") > 0) | (zero("covered") < 4) | (F.col("comparative") < 3)),
        ("LOW_COMPARATIVE_VALUE", zero("differ") < 3),
    ]
    return both.select("topic", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(c)) for c, bad in codes]))).alias("code"))


def undeclared(leaves: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc, path): public texts (doc, path, text) without a claim (doc, path, claim) at their path that shares a token."""
    c = claims.select("doc", "path", F.explode(claim_tokens(F.col("claim"))).alias("token")).distinct()
    have = leaves.select("doc", "path", F.explode(claim_tokens(F.col("text"))).alias("token")).distinct().join(c, ["doc", "path", "token"], "left_semi").select("doc", "path").distinct()
    return leaves.select("doc", "path").distinct().join(have, ["doc", "path"], "left_anti")


def repeated_blocks(blocks: DataFrame) -> DataFrame:
    """Documents in which two blocks (doc, zone, text) of different zones and enough tokens are alike.

    Blocks meet on their rarest tokens within a document, not all with all.
    """
    found = claim_tokens(F.col("text"))
    rows = blocks.select("doc", "zone", F.xxhash64("doc", "zone", "text").alias("key"), once(found, lambda ts: F.when(F.size(ts) >= REPEATED_TOKENS, F.array_distinct(ts))).alias("tokens"))
    rows = stored(rows.distinct(), "blocks").where("tokens is not null")
    # Of n tokens, a block that shares ceil(0.7 n) shares one of the first n - ceil(0.7 n) + 1 in any common order.
    head = F.slice(F.sort_array("tokens"), 1, F.size("tokens") - F.ceil(F.size("tokens") * REPEATED_BLOCK - 1e-9).cast("int") + 1)
    # Blocks meet on hashes of tokens, as keys alone; their tokens follow once a pair.
    each = rows.select("doc", "zone", "key", F.explode(head).alias("token")).select("doc", "zone", "key", F.xxhash64("token").alias("token"))
    other = each.select("doc", F.col("zone").alias("zone2"), F.col("key").alias("key2"), "token")
    near = each.join(other, ["doc", "token"]).filter("zone < zone2").select("doc", "key", "key2").distinct()
    near = near.join(rows.select("doc", "key", "tokens"), ["doc", "key"]).join(rows.select("doc", F.col("key").alias("key2"), F.col("tokens").alias("tokens2")), ["doc", "key2"])
    alike = F.size(F.array_intersect("tokens", "tokens2")) >= REPEATED_BLOCK * F.size(F.array_union("tokens", "tokens2")) - 1e-9
    return near.filter(alike).select("doc").distinct()


def repetitions(texts: DataFrame, featured: DataFrame) -> DataFrame:
    """(doc, kind, value, n): prices and hours that a document says more than twice; a featured price (doc, price) counts twice."""
    price = F.regexp_extract_all("text", F.lit(r"\b(\d{1,3}(?:[.,]\d{1,2})?)\s*€"), 1)
    said = texts.select("doc", F.explode(price).alias("p")).select("doc", F.format_string("%.2f", F.replace("p", F.lit(","), F.lit(".")).cast("double")).alias("value"), F.lit(1).alias("w"))
    said = said.unionByName(featured.select("doc", F.format_string("%.2f", F.col("price")).alias("value"), F.lit(2).alias("w"))).withColumn("kind", F.lit("price"))
    hours = texts.select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"\b\d{1,2}:\d{2}\s*[–-]\s*\d{1,2}:\d{2}\b"), 0)).alias("h")).select("doc", F.regexp_replace("h", r"\s*[–-]\s*", "–").alias("value"), F.lit(1).alias("w"), F.lit("hours").alias("kind"))
    return said.unionByName(hours).groupBy("doc", "kind", "value").agg(F.sum("w").alias("n")).filter("n > 2")


def confirmation(tier: Column, origin: Column, direct: Column, enriched: Column, research: Column) -> Column:
    """(outcome, reason) of a candidate: by its tier, direct evidence of its own, and what enrichment found."""
    known = F.coalesce(F.when(research.isin("no-official-website", "no-verifiable-source", "unreachable", "no-usable-content", "no-direct-evidence"), research), F.lit("no-evidence"))
    reason = F.when(tier == "insufficient", "quality").when((origin == "direct") & (direct == 0), "brand-scope").when((origin == "potential") & (enriched == 0), known)
    return F.struct(F.when(reason.isNull(), "confirmed").otherwise("rejected").alias("outcome"), reason.alias("reason"))


def external_acceptance(scopes: Column, classes: Column, outcome: Column) -> Column:
    """Why a fact from outside isn't taken: a brand's claim, or a third party whose identity isn't confirmed; null if it is taken."""
    return F.when(F.array_contains(scopes, "brand"), "BRAND_SCOPE_NOT_LOCAL").when(F.array_contains(classes, "third-party") & (outcome == "mismatch"), "IDENTITY_MISMATCH").when(F.array_contains(classes, "third-party") & (outcome != "confirmed"), "AMBIGUOUS_EXTERNAL_IDENTITY")


def potential_score(evidence: Column, tier: Column, facts: Column, website: Column, sources: Column, specific: Column) -> Column:
    """Sum of six capped terms."""
    quality = F.when(tier == "rich", 3).when(tier == "basic", 2).otherwise(0)
    return F.least(F.lit(12), evidence * 3) + quality + F.least(F.lit(3), facts) + F.when(website, 2).otherwise(0) + F.least(F.lit(2), sources) + F.least(F.lit(3), specific)
