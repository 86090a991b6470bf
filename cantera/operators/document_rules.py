"""The rules of each document type, of nested values and of references, as rows for ``rule_tables``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.operators.nested import json_walk
from cantera.operators.rule_tables import issues, outcomes, violations

# Types, enumerations, formats and lengths of documents.
SLUGGED = ("area", "category", "author", "business", "place", "beach", "event", "article", "comparison")
IN_SPANISH = SLUGGED
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
TIME = r"^([01]\d|2[0-3]):[0-5]\d$"
CATEGORY_GROUPS = "section|businessType|cuisine|feature|topic|placeType"
BUSINESS_KINDS = "restaurant|bar|pub|cafe|hotel|shop|service"
PRICE_RANGES = "€|€€|€€€|€€€€"
PLACE_TYPES = "Mirador|Parque|Monumento|Ruta|Punto de interés"
EVENT_STATUSES = "scheduled|postponed|cancelled|rescheduled"
ARTICLE_SECTIONS = "guides|thingsToDo|information|informationPractical"
DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
TONES = "Consejo|Información|Aviso"
PRICE_UNITS = "per-person|per-portion|per-unit|ambiguous"
REFERENCE = r"^(?!.*\.\.)(?!drafts\.)[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
DOCUMENT = r"^(?!.*\.\.)[A-Za-z0-9][A-Za-z0-9._-]{0,120}$"
# Fixed values: (document type, place of a reference, types it may lead to).
REFERENCES = (
    ("homePage", "featuredGuides[]", "article"),
    ("homePage", "recommendedBusinesses[]", "business"),
    ("homePage", "featuredPlaces[]", "place|beach"),
    ("business", "categories[]", "category"),
    ("business", "features[]", "category"),
    ("business", "area", "area"),
    ("place", "categories[]", "category"),
    ("place", "features[]", "category"),
    ("place", "area", "area"),
    ("beach", "services[]", "category"),
    ("beach", "area", "area"),
    ("beach", "profileContrasts[].beach", "beach"),
    ("beach", "nearbyDining[].comparison", "comparison"),
    ("event", "venue", "place|business"),
    ("event", "categories[]", "category"),
    ("article", "author", "author"),
    ("article", "categories[]", "category"),
    ("article", "relatedContent[]", "business|place|beach|event|article"),
    ("article", "contextLinks[].target", "article|beach"),
    ("comparison", "author", "author"),
    ("comparison", "area", "area"),
    ("comparison", "choiceGuide[].business", "business"),
    ("comparison", "entries[].business", "business"),
)


def _of(kind: str | None, where: str | None, node: str | None, *tests: tuple[str, str, str | None]) -> list[tuple[str | None, ...]]:
    return [(kind, where, node, member, test, bound, "error", f"{member}-{test}") for member, test, bound in tests]


def _seo(kind: str | None, at: str) -> list[tuple[str | None, ...]]:
    return _of(kind, at, None, ("metaTitle", "text-at-most", "60"), ("metaDescription", "text-at-most", "160"), ("noIndex", "optional-boolean", None))


#: By document type.
TYPE_RULES = [
    *_of("siteSettings", "", None, ("_id", "is", "site-settings"), ("siteName", "text", None), ("footerText", "text", None), ("navigation", "list", None), ("navigation", "objects", None), ("diningPage", "object", None), ("defaultSeo", "object", None)),
    *_of("siteSettings", "navigation[]", None, ("label", "text", None), ("href", "text", None)),
    *_of("siteSettings", "", None, *[(p, "optional-object", None) for p in ("beachesPage", "informationPage", "thingsToDoPage")]),
    *[r for p in ("diningPage", "beachesPage", "informationPage", "thingsToDoPage") for r in [*_of("siteSettings", p, None, ("title", "text", None), ("intro", "text", None), ("seo", "object", None)), *_seo("siteSettings", f"{p}.seo")]],
    *_seo("siteSettings", "defaultSeo"),
    *_of("homePage", "", None, ("_id", "is", "homepage"), ("title", "text", None), ("intro", "text", None), ("primaryLinks", "list", "6..6"), ("primaryLinks", "objects", None), ("seo", "object", None)),
    *_of("homePage", "primaryLinks[]", None, *[(f, "text", None) for f in ("label", "href", "description", "accent")]),
    *_of("area", "", None, ("name", "text", None)),
    *_of("category", "", None, ("title", "text", None), ("group", "required-one-of", CATEGORY_GROUPS), ("indexable", "optional-boolean", None)),
    *_of("author", "", None, ("name", "text", None)),
    *_of("business", "", None, ("name", "text", None), ("businessKind", "required-one-of", BUSINESS_KINDS), ("shortDescription", "text", None), ("shortDescription", "at-most", "240"), ("priceRange", "one-of", PRICE_RANGES), ("commercialRelationship", "absent", None)),
    *_of("place", "", None, ("name", "text", None), ("shortDescription", "text", None), ("placeType", "one-of", PLACE_TYPES)),
    *_of("beach", "", None, ("name", "text", None), ("shortDescription", "text", None), ("lengthMeters", "positive", None), ("choiceNote", "optional-full-text", None), ("profileContrasts", "optional-list", None), ("profileContrasts", "objects", None), ("nearbyDining", "optional-list", None), ("nearbyDining", "objects", None)),
    *_of("beach", "profileContrasts[]", None, ("reason", "text", None)),
    *_of("beach", "nearbyDining[]", None, ("note", "text", None)),
    *_of("event", "", None, ("name", "text", None), ("shortDescription", "text", None), ("startDate", "date-time", None), ("endDate", "optional-date-time", None), ("eventStatus", "required-one-of", EVENT_STATUSES)),
    *_of("article", "", None, ("title", "text", None), ("section", "required-one-of", ARTICLE_SECTIONS), ("excerpt", "text", None), ("excerpt", "at-most", "240"), ("body", "list", "1.."), ("publishedAt", "date-time", None), ("updatedAt", "optional-date-time", None), ("contextLinks", "optional-list", None), ("contextLinks", "objects", None)),
    *_of("article", "contextLinks[]", None, ("note", "text", None)),
    *_of("comparison", "", None, ("title", "text", None), ("topic", "text", None), ("category", "is", "donde-comer"), ("intro", "text", None), ("quickVerdict", "text", None), ("methodology", "text", None), ("lastVerified", "date", None), ("criteria", "texts", "3.."), ("choiceGuide", "list", "4..8"), ("choiceGuide", "objects", None), ("entries", "list", "4..8"), ("entries", "objects", None)),
    *_of("comparison", "choiceGuide[]", None, ("_type", "is", "comparisonChoice"), ("business", "reference", None), ("business", "unique", None), ("label", "text", None), ("reason", "text", None)),
    *_of("comparison", "entries[]", None, ("_type", "is", "comparisonEntry"), ("business", "reference", None), ("business", "unique", None), ("verdict", "text", None), ("conditions", "optional-texts", None), *[(f, "texts", None) for f in ("strengths", "limitations", "bestFor", "practicalNotes")], ("featuredItem", "optional-object", None)),
    *_of("comparison", "entries[].featuredItem", None, ("name", "text", None), ("price", "optional-number", "0.."), ("currency", "optional-is", "EUR"), ("priceQualifier", "optional-full-text", None), ("priceUnit", "one-of", PRICE_UNITS), ("source", "text", None), ("retrievedAt", "matches", r"^\d{4}-\d{2}-\d{2}$")),
]
#: For all types: ids, slugs, language, web addresses.
COMMON_RULES = [
    *_of(None, "", None, ("_id", "matches", DOCUMENT), ("lastVerified", "optional-date", None), ("website", "optional-web-address", None), ("googleMapsUrl", "optional-web-address", None), ("ticketUrl", "optional-web-address", None), ("seo", "optional-object", None)),
    *_seo(None, "seo"),
    *[r for t in SLUGGED for r in _of(t, "", None, ("slug", "object", None))],
    *_of(None, None, "slug", ("current", "matches", SLUG)),
    *[r for t in IN_SPANISH for r in _of(t, "", None, ("language", "is", "es"))],
]
#: By the type of a nested value, wherever it stands.
NESTED_RULES = [
    *_of(None, None, "openingHours", ("day", "required-one-of", DAYS), ("opens", "optional-matches", TIME), ("closes", "optional-matches", TIME)),
    *_of(None, None, "callout", ("tone", "one-of", TONES), ("text", "text", None)),
    *_of(None, None, "comparisonTable", ("caption", "text", None), ("columns", "strings", "2..")),
    *_of(None, None, "source", ("title", "matches", "."), ("url", "web-address", None), ("accessedAt", "optional-date", None)),
    *_of(None, None, "geopoint", ("lat", "number", "-90..90"), ("lng", "number", "-180..180")),
    *_of(None, None, "image", ("alt", "text", None), ("asset", "reference", None)),
    *_of(None, None, "reference", ("_ref", "matches", REFERENCE), ("_weak", "optional-boolean", None)),
]
#: Members that must be references, or lists of objects, by document type.
REFERENCE_RULES = [
    *[(t, "", None, p.removesuffix("[]"), "optional-list" if p.endswith("[]") else "optional-reference", None, "error", f"{p}-form") for t, p, _ in REFERENCES if "." not in p],
    *[(t, "", None, p.removesuffix("[]"), "objects", None, "error", f"{p}-items") for t, p, _ in REFERENCES if p.endswith("[]") and "." not in p],
    *[(t, p, None, "_type", "is", "reference", "error", f"{p}-form") for t, p, _ in REFERENCES if p.endswith("[]") and "." not in p],
]
RULES = [*TYPE_RULES, *COMMON_RULES, *NESTED_RULES, *REFERENCE_RULES]


def walked(documents: DataFrame, column: str = "json", rules: list[tuple[str | None, ...]] | None = None) -> DataFrame:
    """Objects of documents (id, json, …); only what ``document_issues`` needs of them, if its rules are given."""
    if rules is None:
        return json_walk(documents, column, F.col("id"))
    return json_walk(documents, column, F.col("id"), [r[:3] for r in rules], {r[3] for r in rules}, ("path", "place", "root_type", "pos", "type", "members"))


def walked_references(documents: DataFrame, column: str = "json") -> DataFrame:
    """The references in documents (id, json, …), with what ``references`` needs of them."""
    return json_walk(documents, column, F.col("id"), [(None, None, "reference")], ("_ref", "_weak"), ("path", "place", "root_type", "type", "members"))


def document_issues(nodes: DataFrame, rules: list[tuple[str | None, ...]] = RULES) -> DataFrame:
    """(id, path, code, severity) of documents that ``walked`` has read; texts that aren't JSON have the code ``json``."""
    return violations(nodes, rules, ["id"])


def text_issues(documents: DataFrame, rules: list[tuple[str | None, ...]] = RULES) -> DataFrame:
    """What ``document_issues`` finds, of documents (id, json, …) that need no other walk."""
    return issues(documents, rules)


def references(nodes: DataFrame, rules: tuple[tuple[str, str, str], ...] = REFERENCES) -> DataFrame:
    """(id, path, ref, weak, allowed): the valid references in documents; allowed lists types where a rule does."""
    spark = nodes.sparkSession
    allowed = spark.createDataFrame(list(rules), "of string, at string, allowed string")
    m = lambda name: F.try_element_at("members", F.lit(name))
    rows = nodes.where((F.col("type") == "reference") & m("_ref")["text"].rlike(REFERENCE)).select("id", "root_type", "path", "place", m("_ref")["text"].alias("ref"), F.coalesce(m("_weak")["text"] == "true", F.lit(False)).alias("weak"))
    rows = rows.join(F.broadcast(allowed), (F.col("root_type") == F.col("of")) & (F.col("place") == F.col("at")), "left")
    return rows.select("id", "path", "ref", "weak", F.split("allowed", r"\|").alias("allowed"))


def reference_faults(found: DataFrame, documents: DataFrame, whole: bool = False) -> DataFrame:
    """(id, path, ref, fault): references to no document (weak ones may) or to one of another type than allowed; all others too, with a null, if ``whole``. Types are read from documents (id, json) or from their column ``kind``."""
    kind = F.col("kind") if "kind" in documents.columns else F.get_json_object("json", "$._type")
    known = documents.select(F.col("id").alias("ref"), kind.alias("kind")).dropDuplicates(["ref"])
    both = found.join(known, "ref", "left")
    fault = F.when(F.col("kind").isNull() & ~F.col("weak"), "missing").when(F.col("kind").isNotNull() & ~F.array_contains("allowed", F.col("kind")), "wrong-type")
    rows = both.select("id", "path", "ref", fault.alias("fault"))
    return rows if whole else rows.where("fault is not null")


def document_outcomes(found: DataFrame, documents: DataFrame, types: Column | None = None) -> DataFrame:
    return outcomes(found, documents, "id", types)
