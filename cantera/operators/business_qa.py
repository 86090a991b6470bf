"""Quality checks of business pages: what was written against what is known, with an outcome for each.

Inputs: candidates (id, tier); enriched (id, facts, sources), facts being a map from field to
(kind, value, sources) with values as JSON texts, sources a list of (key, provider,
identifier, url, retrieved, attribution); documents (id, name, kind, address, phone, website,
lat, lng, last_verified, short, body, seo_title, seo_description, source_urls, extra), body a
list of (text, style, list_item) and extra the names of other fields that are set.

Codes that look at one business are arrays of conditions over one joined row, exploded once.
Codes about several are group sizes, or pairs by rare tokens and by cosine; no business meets
all others. Findings of the schema come from ``document_rules`` and are handed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.functions.extract import sentences, stem_match
from cantera.functions.text import fold, jaccard, once
from cantera.operators.pairs import cosine_pairs, jaccard_pairs, spread

# Fields that tell a business from others, in two uses, and the words that speak of them.
DISTINCTIVE = ("cuisine", "concept", "specialties", "distinctiveFeatures", "services", "terrace", "takeaway", "delivery", "bookingAvailability", "accessibility", "locationContext")
EDITORIAL = (*DISTINCTIVE, "openingInformation")
FIELD_WORDS = {
    "cuisine": "cocina gastronomia culinaria",
    "concept": "concepto propuesta",
    "specialties": "especialidad especialidades plato platos arroz arroces pasta pizza focaccia",
    "services": "servicio servicios desayuno cena menu",
    "bookingAvailability": "reserva reservas reservar",
    "takeaway": "llevar recogida recoger",
    "delivery": "domicilio entrega reparto",
    "terrace": "terraza exterior",
    "accessibility": "accesibilidad accesible",
    "locationContext": "playa levante poniente primera linea paseo casco centro",
    "distinctiveFeatures": "vistas azotea rooftop mar panoramica",
    "openingInformation": "horario horarios abre abierto dias lunes martes miercoles jueves viernes sabado domingo",
}
GENERIC_WORDS = ("restaurante", "negocio", "establecimiento", "opcion", "sitio", "web", "oficial", "informacion", "cocina", "servicio", "servicios", "disponible", "ciudad", "local", "tiene", "para", "como", "desde", "sobre")
# Phrases that say nothing (after a town's name, if one is given), synonyms, and fields without facts.
GENERIC = (
    r"(?i)figura como restaurante|establecimiento de restauraci[oó]n|incluido en la oferta local|una opci[oó]n para quienes buscan|informaci[oó]n b[aá]sica disponible"
    r"|consulta (?:su|el) sitio web oficial|dispone de (?:una |su )?(?:p[aá]gina|sitio) web"
)
SYNONYMS = {
    "restaurante": "local", "establecimiento": "local", "negocio": "local", "situado": "ubicacion", "ubicada": "ubicacion", "ubicado": "ubicacion", "cocina": "gastronomia", "culinaria": "gastronomia", "platos": "comida",
    "especialidades": "comida", "terraza": "exterior", "reservar": "reserva", "reservas": "reserva", "domicilio": "delivery", "entrega": "delivery", "llevar": "takeaway",
}
UNSOURCED = ("priceRange", "openingHours", "googleMapsUrl", "rating", "reviews", "awards", "services")
LEXICAL, SEMANTIC, REPEATED = 0.68, 0.88, 0.8
ISSUE = ["id", "severity", "code", "path"]


def _words(text: Column) -> Column:
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def _fact(name: str) -> Column:
    return F.try_element_at("facts", F.lit(name))


def useful_fact(fact: Column) -> Column:
    """A fact with sources whose value isn't null, false, blank or an empty list."""
    empty = fact["value"].isNull() | (fact["kind"] == "null") | (F.trim(fact["value"]) == "") | ((fact["kind"] == "boolean") & (fact["value"] == "false")) | ((fact["kind"] == "array") & fact["value"].rlike(r'^\[(\s*"\s*"\s*,?)*\s*\]$'))
    return F.coalesce((F.size(fact["sources"]) > 0) & ~empty, F.lit(False))


def tier() -> Column:
    """insufficient, basic or rich, by the facts of a row."""
    has = lambda *names: F.greatest(*[useful_fact(_fact(n)) for n in names], F.lit(False))
    dimensions = [has("cuisine", "concept"), has("specialties", "services", "takeaway", "delivery"), has("terrace", "distinctiveFeatures"), has("locationContext"), has("bookingAvailability", "accessibility", "openingInformation", "openingHoursRaw")]
    answered = sum((d.cast("int") for d in dimensions), F.lit(0))
    enough = has("name") & has("businessKind") & has("address", "location", "locationContext") & has(*DISTINCTIVE)
    return F.when(~enough, "insufficient").when(dimensions[0] & (answered >= 3), "rich").otherwise("basic")


def _complete(s: Column) -> Column:
    out = F.lit(True)
    for name in ("provider", "identifier", "url", "retrieved", "attribution"):
        out = out & F.coalesce(s[name] != "", F.lit(False))
    return out


def _editorial(fail, warn, town: str | None) -> list[Column]:
    """Conditions on what a page says, over arrays of its sentences and of the words of its facts."""
    fields = F.filter(F.map_entries("facts"), lambda e: e["key"].isin(*EDITORIAL) & useful_fact(e["value"]))
    spoken = F.from_json(F.lit("{" + ", ".join(f'"{k}": "{v}"' for k, v in FIELD_WORDS.items()) + "}"), "map<string,string>")
    own = lambda e: F.filter(_words(e["value"]["value"]), lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_WORDS))
    vocabulary = F.transform(fields, lambda e: F.concat(own(e), F.split(F.coalesce(spoken[e["key"]], F.lit("")), " ")))
    body = F.coalesce("body", F.slice(F.array(F.struct(F.lit("").alias("text"), F.lit("").alias("style"), F.lit(False).alias("list_item"))), 1, 0))
    text = F.array_join(F.concat(F.array(F.coalesce("short", F.lit(""))), F.transform(F.filter(body, lambda b: b["style"] != "h2"), lambda b: b["text"])), "\n")
    generic = GENERIC + (rf"|restaurante (?:situado|ubicado) en {town}|ubicad[oa] en {town}" if town else "")

    def about(words: Column, vocabulary: Column) -> Column:
        return F.exists(vocabulary, lambda f: F.exists(f, lambda w: stem_match(words, w)))

    def judged(x: Column) -> Column:
        said, vocab = x["said"], x["vocabulary"]
        covered = F.size(F.filter(vocab, lambda f: F.exists(f, lambda w: stem_match(x["content"], w))))
        backed = F.size(F.filter(said, lambda s: about(_words(s), vocab)))
        empty = F.size(F.filter(said, lambda s: s.rlike(generic) & ~about(_words(s), vocab)))
        return F.struct(covered.alias("covered"), F.when(F.size(said) > 0, backed / F.size(said)).otherwise(0.0).alias("ratio"), empty.alias("generic"), F.size(said).alias("n"), F.exists(F.filter(body, lambda b: b["list_item"]), lambda b: ~about(_words(b["text"]), vocab)).alias("loose"))

    found = once(F.struct(sentences(text).alias("said"), vocabulary.alias("vocabulary"), _words(text).alias("content")), judged)
    rich = F.col("tier") == "rich"
    low = lambda j: (j["covered"] < F.when(rich, 2).otherwise(1)) | (j["ratio"] < F.when(rich, 0.55).otherwise(0.35)) | ((j["n"] > 2) & (j["generic"] >= F.ceil(j["n"] / 2)))
    heads = F.array_distinct(F.transform(F.filter(body, lambda b: b["style"] == "h2"), lambda b: fold(b["text"])))
    paragraphs = F.filter(body, lambda b: (b["style"] != "h2") & ~b["list_item"])
    same = F.exists(paragraphs, lambda b: jaccard(F.array_distinct(_words(F.col("short"))), F.array_distinct(_words(b["text"]))) >= REPEATED)
    codes = lambda j: F.array(fail(j["generic"] > 0, "GENERIC_EDITORIAL_CONTENT", "body"), fail(j["loose"], "unsupported-highlight", "body"), fail(low(j), "LOW_INFORMATION_DENSITY", "body"))
    return [once(found, codes), F.array(warn(rich & (F.size(heads) < 2), "LOW_SECTION_VARIETY", "body"), warn(rich & same, "REPEATED_SHORT_DESCRIPTION", "body"))]


def own_issues(candidates: DataFrame, enriched: DataFrame, documents: DataFrame, bounds: tuple[float, float, float, float] | None = None, town: str | None = None) -> DataFrame:
    """(id, severity, code, path): what one business shows by itself. bounds: least and greatest latitude, then longitude."""
    # Facts and pages of many businesses are alike and shrink when they are sent, so tasks aren't merged by the bytes sent: each sorts what it reads.
    rows = spread(candidates.select("id", "tier"), "id").join(enriched.withColumn("_known", F.lit(True)), "id", "left").join(documents.withColumn("_made", F.lit(True)), "id", "left")
    c = F.col
    known, made = c("_known").isNotNull(), c("_made").isNotNull()
    one = lambda level: lambda bad, code, path: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(level).alias("severity"), F.lit(code).alias("code"), F.lit(path).alias("path")))
    fail, warn, skip = one("FAIL"), one("WARNING"), one("SKIPPED")
    blank = lambda x: ~F.coalesce(F.trim(x) != "", F.lit(False))
    keys = F.transform("sources", lambda s: s["key"])
    loose = F.exists(F.map_values("facts"), lambda f: (f["value"].isNotNull() & (f["kind"] != "null") & (F.size(f["sources"]) == 0)) | F.exists(f["sources"], lambda k: ~F.array_contains(keys, k)))
    urls = F.array_sort(F.array_compact(F.transform("sources", lambda s: F.nullif(s["url"], F.lit("")))))
    expected = lambda name: F.when(_fact(name)["kind"] != "null", _fact(name)["value"])
    differs = lambda name, actual: fail(~expected(name).eqNullSafe(actual), "factual-integrity", name)
    place = F.when(c("lat").isNotNull() & c("lng").isNotNull(), F.concat(c("lat"), F.lit(","), c("lng")))
    latest = F.substring(F.array_max(F.transform("sources", lambda s: s["retrieved"])), 1, 10)
    outside = ~(c("lat").between(*bounds[:2]) & c("lng").between(*bounds[2:])) if bounds else F.lit(False)
    page = [
        fail(F.size(F.coalesce("source_urls", F.array())) == 0, "sources", "sources"),
        fail((F.size("source_urls") > 0) & ~F.array_sort("source_urls").eqNullSafe(urls), "source-integrity", "sources"),
        fail(blank(c("short")), "incomplete", "shortDescription"),
        fail(~F.coalesce(F.size("body") > 0, F.lit(False)), "incomplete", "body"),
        fail(blank(c("seo_title")) | blank(c("seo_description")), "incomplete", "seo"),
        warn(outside, "coordinates-outside-bounds", "location"),
        differs("name", c("name")), differs("businessKind", c("kind")), differs("address", c("address")), differs("phone", c("phone")), differs("website", c("website")), differs("location", place),
        fail(~latest.eqNullSafe(c("last_verified")), "factual-integrity", "lastVerified"),
        *[fail(F.array_contains("extra", f), "unsupported-fact", f) for f in UNSOURCED],
    ]
    base = F.array(
        fail(tier() != c("tier"), "quality-tier-mismatch", "qualityTier"),
        fail(loose | F.exists("sources", lambda s: ~_complete(s)), "fact-provenance", "facts"),
        fail(F.exists("sources", lambda s: ~_complete(s)), "source-provenance", "sources"),
        fail(~made, "missing-document", "document"),
    )
    written = F.flatten(F.array(F.array(*page), *_editorial(fail, warn, town)))
    found = F.when(c("tier") == "insufficient", F.array(skip(F.lit(True), "INSUFFICIENT_FACTS", "qualityTier"))).when(~known, F.array(fail(F.lit(True), "missing-enrichment", ""))).when(~made, base).otherwise(F.concat(base, written))
    return rows.select("id", F.explode(F.array_compact(found)).alias("x")).select("id", "x.*")


def shared_issues(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, severity, code, path): the same entity, title or description twice, and texts that are nearly alike."""
    docs = documents.join(candidates.where("tier <> 'insufficient'").select("id"), "id", "left_semi")
    spot = lambda x: F.coalesce(F.format_string("%.4f", x), F.lit("unknown"))
    groups = [
        ("duplicate-entity", "name", F.concat_ws(":", fold(F.coalesce("name", F.lit(""))), spot(F.col("lat")), spot(F.col("lng")))),
        ("duplicate-seo-title", "seo.metaTitle", F.when(F.trim("seo_title") != "", fold(F.col("seo_title")))),
        ("duplicate-meta-description", "seo.metaDescription", F.when(F.trim("seo_description") != "", fold(F.col("seo_description")))),
    ]
    keys = docs.select("id", F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"), key.alias("key")) for code, path, key in groups])).alias("g")).select("id", "g.*").where("key IS NOT NULL")
    many = keys.groupBy("code", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("code").alias("_c"), F.col("key").alias("_k"))
    out = keys.join(many, (F.col("code") == F.col("_c")) & (F.col("key") == F.col("_k"))).select("id", F.lit("FAIL").alias("severity"), "code", "path")
    # Texts that have two words or more; a page's paragraphs are texts of their own.
    plain = F.filter("body", lambda b: (b["style"] != "h2") & ~b["list_item"])
    texts = F.concat(F.array(F.struct(F.lit("shortDescription").alias("path"), F.col("short").alias("text")), F.struct(F.lit("seo.metaDescription").alias("path"), F.col("seo_description").alias("text"))), F.coalesce(F.transform(plain, lambda b: F.struct(F.lit("body.paragraphs").alias("path"), b["text"].alias("text"))), F.array()))
    texts = docs.select("id", F.posexplode(texts).alias("k", "t")).select("id", "k", "t.*").withColumn("words", _words(F.col("text"))).where(F.size("words") >= 2)
    synonyms = F.from_json(F.lit("{" + ", ".join(f'"{k}": "{v}"' for k, v in SYNONYMS.items()) + "}"), "map<string,string>")
    for path in ("shortDescription", "seo.metaDescription", "body.paragraphs"):
        rows = texts.where(F.col("path") == path).select(F.struct("id", "k").alias("key"), "words")
        sets = rows.select("key", F.array_distinct("words").alias("tokens"))
        lexical = jaccard_pairs(sets, sets, LEXICAL).select("a", "b")
        counts = rows.select("key", F.explode(F.transform(F.filter("words", lambda w: F.length(w) > 2), lambda w: F.coalesce(synonyms[w], w))).alias("token")).groupBy("key", "token").agg(F.count("*").alias("n"))
        semantic = cosine_pairs(counts, counts, SEMANTIC).select("a", "b")
        pairs = lexical.unionByName(semantic).where("a.id <> b.id").select(F.col("a.id").alias("id")).distinct()
        out = out.unionByName(pairs.select("id", F.lit("WARNING").alias("severity"), F.lit("similar-content").alias("code"), F.lit(path).alias("path")))
    order = F.transform(F.filter("body", lambda b: b["style"] == "h2"), lambda b: fold(b["text"]))
    shapes = docs.select("id", order.alias("heads")).where(F.size("heads") >= 2).withColumn("key", F.array_join("heads", "|")).where(F.size(_words(F.col("key"))) >= 2)
    alike = shapes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_k"))
    return out.unionByName(shapes.join(alike, F.col("key") == F.col("_k")).select("id", F.lit("WARNING").alias("severity"), F.lit("similar-content").alias("code"), F.lit("body.structure").alias("path")))


def inspect(candidates: DataFrame, enriched: DataFrame, documents: DataFrame, schema: DataFrame | None = None, bounds: tuple[float, float, float, float] | None = None, town: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(issues, outcomes): each code and path of a business once; SKIPPED, FAIL, WARNING or PASS for every candidate.

    ``schema`` has (id, path) of documents that break their schema.
    """
    found = own_issues(candidates, enriched, documents, bounds, town).unionByName(shared_issues(candidates, documents))
    if schema is not None:
        shown = candidates.where("tier <> 'insufficient'").select("id")
        found = found.unionByName(schema.join(shown, "id", "left_semi").select("id", F.lit("FAIL").alias("severity"), F.lit("schema").alias("code"), "path"))
    found = found.distinct()
    worst = found.groupBy("id").agg(F.bool_or(F.col("severity") == "FAIL").alias("_f"), F.bool_or(F.col("severity") == "WARNING").alias("_w"))
    name = F.when(F.col("tier") == "insufficient", "SKIPPED").when(F.col("_f"), "FAIL").when(F.col("_w"), "WARNING").otherwise("PASS")
    return found.select(*ISSUE), candidates.join(worst, "id", "left").select("id", "tier", name.alias("outcome"))
