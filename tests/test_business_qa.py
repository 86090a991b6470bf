"""Business checks: every code is hit by the business that it is about, and by no other."""

from cantera.operators import business_qa

DOC = "id string, name string, kind string, address string, phone string, website string, lat double, lng double, last_verified string, short string, body array<struct<text: string, style: string, list_item: boolean>>, seo_title string, seo_description string, source_urls array<string>, extra array<string>"
FACTS = "id string, facts map<string, struct<kind: string, value: string, sources: array<string>>>, sources array<struct<key: string, provider: string, identifier: string, url: string, retrieved: string, attribution: string>>"
SOURCE = ("s", "osm", "1", "https://s.example", "2026-01-02T00:00:00Z", "OSM")


def facts(name, **more):
    base = {"name": ("string", name, ["s"]), "businessKind": ("string", "restaurant", ["s"]), "address": ("string", "Calle 1", ["s"]), "cuisine": ("string", "Arroces valencianos", ["s"])}
    return base | more


RICH = {"specialties": ("array", '["Paella marinera"]', ["s"]), "terrace": ("boolean", "true", ["s"]), "locationContext": ("string", "Junto al puerto", ["s"])}


def doc(id_, name, **more):
    base = {
        "id": id_, "name": name, "kind": "restaurant", "address": "Calle 1", "phone": None, "website": None, "lat": None, "lng": None, "last_verified": "2026-01-02", "short": f"Arroces valencianos de {name} en casa",
        "body": [(f"La cocina valenciana de {name} gira sobre los arroces.", "normal", False)], "seo_title": f"Titulo {name}", "seo_description": f"{name} describe {id_} con {name * 2} propio {id_ * 3}", "source_urls": ["https://s.example"], "extra": [],
    }
    return tuple((base | more).values())


def run(spark, cases, **kw):
    """cases: id -> (tier, facts or None, sources, document or None)."""
    candidates = spark.createDataFrame([(k, c[0]) for k, c in cases.items()], "id string, tier string")
    enriched = spark.createDataFrame([(k, c[1], c[2]) for k, c in cases.items() if c[1] is not None], FACTS)
    documents = spark.createDataFrame([c[3] for c in cases.values() if c[3] is not None], DOC)
    schema = spark.createDataFrame([("schema", "slug"), ("skipped", "slug")], "id string, path string")
    issues, outcomes = business_qa.inspect(candidates, enriched, documents, schema, (38.4, 38.7, -0.3, 0.0), "villa")
    got = {}
    for r in issues.collect():
        got.setdefault(r.id, set()).add((r.code, r.path))
    return got, {r.id: r.outcome for r in outcomes.collect()}


def test_codes(spark):
    names = iter("Faro Timon Ancla Brisa Coral Delta Ebano Fenix Gala Hiedra Iris Jara Kappa Lago Marea Norte Olivo Perla Quilla Roca Sal Trigo Urano Vela Xalo Yedra Zafiro".split())
    n = lambda: next(names)
    good = n()
    cases = {"good": ("basic", facts(good), [SOURCE], doc("good", good))}

    def case(id_, tier="basic", more=None, sources=None, **fields):
        name = n()
        cases[id_] = (tier, facts(name, **(more or {})), sources if sources is not None else [SOURCE], doc(id_, name, **fields))

    cases["skipped"] = ("insufficient", None, None, None)
    cases["no-facts"] = ("basic", None, None, doc("no-facts", n()))
    name = n()
    cases["no-doc"] = ("basic", facts(name), [SOURCE], None)
    case("tier", "rich")
    case("loose", more={"phone": ("string", "1", [])}, phone="1")
    case("unknown-source", more={"cuisine": ("string", "Arroces valencianos", ["s", "gone"])})
    case("source", sources=[(*SOURCE[:5], "")])
    case("no-urls", source_urls=[])
    case("other-urls", source_urls=["https://other.example"])
    case("bare", short=" ", body=[], seo_title=None)
    case("far", more={"location": ("object", "10.0,10.0", ["s"])}, lat=10.0, lng=10.0)
    case("differs", phone="5", last_verified="2026-01-03")
    case("extra", extra=["rating", "openingHours", "fine"])
    case("generic", body=[("Los arroces valencianos son de la casa. Es un local ubicado en Villa desde siempre.", "normal", False)])
    case("loose-highlight", body=[("Los arroces valencianos son de la casa.", "normal", False), ("Aparcamiento gratuito", "normal", True)])
    case("thin", short="Un sitio muy agradable", body=[("Nada que ver aqui. Tampoco hay algo alli. Quiza otro dia sea.", "normal", False)])
    name = n()
    cases["repeats"] = ("rich", facts(name, **RICH), [SOURCE], doc("repeats", name, short=f"Paella marinera con terraza de {name}", body=[("Cocina", "h2", False), (f"Paella marinera con terraza de {name}", "normal", False)]))
    name = n()
    cases["varied"] = ("rich", facts(name, **RICH), [SOURCE], doc("varied", name, short=f"Terraza junto al puerto {name}", body=[("Cocina", "h2", False), (f"Sirve paella valenciana {name}.", "normal", False), ("Sitio", "h2", False), ("Terraza", "normal", True)]))
    case("schema")
    for k in ("twin-a", "twin-b"):
        cases[k] = ("basic", facts("Gemelo"), [SOURCE], doc(k, "Gemelo", short=f"Arroces {k * 2} del puerto", seo_title=f"T {k}", seo_description=f"Sobre {k * 2} y {k * 3}", body=[(f"Arroces valencianos {k} para {k * 2}.", "normal", False)]))
    case("seo-a", seo_title="Mismo título", seo_description="Uno aa bb cc")
    case("seo-b", seo_title="MISMO TITULO", seo_description="Otra dd ee ff")
    case("desc-a", seo_description="Misma descripción larga")
    case("desc-b", seo_description="misma descripcion larga")
    got, outcome = run(spark, cases)
    # The texts of these pages are alike; pairs have a test of their own.
    got = {k: own for k, v in got.items() if (own := {x for x in v if x[0] != "similar-content"})}
    assert got == {
        "skipped": {("INSUFFICIENT_FACTS", "qualityTier")}, "no-facts": {("missing-enrichment", "")}, "no-doc": {("missing-document", "document")},
        "tier": {("quality-tier-mismatch", "qualityTier"), ("LOW_SECTION_VARIETY", "body"), ("LOW_INFORMATION_DENSITY", "body")}, "loose": {("fact-provenance", "facts")}, "unknown-source": {("fact-provenance", "facts")},
        "source": {("fact-provenance", "facts"), ("source-provenance", "sources")}, "no-urls": {("sources", "sources")}, "other-urls": {("source-integrity", "sources")},
        "bare": {("incomplete", "shortDescription"), ("incomplete", "body"), ("incomplete", "seo"), ("LOW_INFORMATION_DENSITY", "body")}, "far": {("coordinates-outside-bounds", "location")},
        "differs": {("factual-integrity", "phone"), ("factual-integrity", "lastVerified")}, "extra": {("unsupported-fact", "rating"), ("unsupported-fact", "openingHours")},
        "generic": {("GENERIC_EDITORIAL_CONTENT", "body")}, "loose-highlight": {("unsupported-highlight", "body")}, "thin": {("LOW_INFORMATION_DENSITY", "body")},
        "repeats": {("LOW_SECTION_VARIETY", "body"), ("REPEATED_SHORT_DESCRIPTION", "body")}, "schema": {("schema", "slug")},
        "twin-a": {("duplicate-entity", "name")}, "twin-b": {("duplicate-entity", "name")}, "seo-a": {("duplicate-seo-title", "seo.metaTitle")}, "seo-b": {("duplicate-seo-title", "seo.metaTitle")},
        "desc-a": {("duplicate-meta-description", "seo.metaDescription")}, "desc-b": {("duplicate-meta-description", "seo.metaDescription")},
    }
    assert (outcome["skipped"], outcome["far"], outcome["tier"]) == ("SKIPPED", "WARNING", "FAIL")


def test_similar_pages(spark):
    heads = [("Cocina y carta", "h2", False), ("Sitio", "h2", False)]
    cases = {}
    for k, short, meta, text in (("a", "Uno dos tres cuatro cinco", "m1 n1", "El restaurante reserva platos de arroz fino"), ("b", "uno dos tres cuatro seis cinco", "m2 n2", "El establecimiento reservas comida de arroz fino"), ("c", "Arroces valencianos siete ocho nueve", "m3 n3", "otra cosa muy distinta")):
        cases[k] = ("basic", facts(k * 4), [SOURCE], doc(k, k * 4, short=short, seo_description=meta, body=[*(heads if k != "c" else heads[::-1]), (text, "normal", False)]))
    got, outcome = run(spark, cases)
    alike = {k: {p for c, p in v if c == "similar-content"} for k, v in got.items()}
    assert outcome["c"] == "PASS"
    assert alike["a"] == alike["b"] == {"shortDescription", "body.paragraphs", "body.structure"} and "c" not in alike


def test_rows_of_businesses_are_not_merged_into_few_tasks(spark):
    from cantera.plans.business_qa import part_pages

    found = business_qa.own_issues(*part_pages(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")))
    assert "RepartitionByExpression [id#" in found._jdf.queryExecution().optimizedPlan().toString()
