"""The recursive walk, array keys, and rules as rows."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cantera.operators import document_rules, nested, rule_tables


def walk_by_hand(value, path="", depth=0):
    if isinstance(value, list):
        for k, x in enumerate(value):
            yield from walk_by_hand(x, f"{path}[{k}]", depth + 1)
    elif isinstance(value, dict):
        yield path, depth, value
        for k, x in value.items():
            yield from walk_by_hand(x, f"{path}.{k}" if path else k, depth + 1)


DOC = {"_type": "page", "@graph": [[{"@type": ["A", 3, "B"], "v": 1.50}], {"_type": "x", "_key": "own"}, 5], "deep": {"a": {"b": [{}]}}, "t": " ", "n": None, "texts": ["a", " "], "mixed": ["a", 1], "none": [], "ref": {"_type": "reference", "_ref": "to"}}


def test_walk(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows = [("d", json.dumps(DOC)), ("list", '[{"a": {"b": 1}}, 2]'), ("scalar", "3"), ("bad", '{"a": '), ("nan", '{"a": NaN}'), ("deep", deep), ("null", None), ("twice", '{"a": 1, "a": {"b": 2}}'), (None, '{"ñ": "é"}')]
    df = spark.createDataFrame(rows, "id string, json string").repartition(3)
    got = [r.asDict(recursive=True) for r in nested.json_walk(df, "json", F.col("id")).collect()]
    paths = lambda doc: sorted((r["path"], r["depth"]) for r in got if r["id"] == doc)
    assert paths("d") == sorted((p, d) for p, d, _ in walk_by_hand(DOC))
    assert paths("list") == [("[0]", 1), ("[0].a", 2)]
    assert paths("scalar") == paths("null") == []
    assert [r["path"] for r in got if r["id"] in ("bad", "nan", "deep")] == [None] * 3
    assert paths("twice") == [("", 0), ("a", 1)] and paths(None) == [("", 0)]
    by = {r["path"]: r for r in got if r["id"] == "d"}
    assert by["@graph[0][0]"]["types"] == ["A", "B"] and by["@graph[0][0]"]["place"] == "@graph[][]" and by["@graph[0][0]"]["parent"] == ""
    assert by["@graph[0][0]"]["node_key"] == hashlib.sha1(b"d:@graph[0]:0").hexdigest()[:12]
    assert by["@graph[1]"]["node_key"] == "own" and by["deep"]["node_key"] is None
    m = by[""]["members"]
    assert {k: (v["kind"], v["size"], v["items"], v["blanks"]) for k, v in m.items() if v["kind"] == "array"} == {"@graph": ("array", 3, "mixed", 0), "texts": ("array", 2, "string", 1), "mixed": ("array", 2, "mixed", 0), "none": ("array", 0, None, 0)}
    assert (m["ref"]["text"], m["ref"]["type"], m["n"]["kind"]) == ("to", "reference", "null") and by["@graph[0][0]"]["members"]["v"]["text"] == "1.5"
    assert all(r["root_type"] == "page" for r in by.values())
    with pytest.raises(ValueError, match="taken"):
        nested.json_walk(df.withColumn("Path", F.lit(1)), "json")


def test_walk_as_table_function(spark):
    nested.register(spark)
    spark.createDataFrame([("d", json.dumps(DOC))], "id string, json string").createOrReplaceTempView("walked_docs")
    got = spark.sql("SELECT id, o.path, o.depth FROM walked_docs, LATERAL json_objects(json, id) o").collect()
    assert sorted((r.path, r.depth) for r in got) == sorted((p, d) for p, d, _ in walk_by_hand(DOC))


def test_keys(spark):
    df = spark.createDataFrame([("d", '{"a": [{"b": [{"c": 1}, "x"]}, {"_key": "own"}], "n": [[{"é": null}]]}'), ("e", "no json"), ("f", None)], "id string, json string")
    got = dict(df.select("id", nested.keyed(F.col("json"), F.col("id"))).collect())
    key = lambda path, k: hashlib.sha1(f"d:{path}:{k}".encode()).hexdigest()[:12]
    assert json.loads(got["d"]) == {"a": [{"b": [{"c": 1, "_key": key("a[0].b", 0)}, "x"], "_key": key("a", 0)}, {"_key": "own"}], "n": [[{"é": None, "_key": key("n[0]", 0)}]]}
    assert (got["e"], got["f"]) == ("no json", None)


def broken(spark, *docs, rules=document_rules.RULES):
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in docs], "id string, json string")
    return {(r.id, r.path, r.code) for r in document_rules.document_issues(document_rules.walked(df), rules).collect()}


def slug(text):
    return {"_type": "slug", "current": text}


def test_rules_of_types(spark):
    ref = lambda to: {"_type": "reference", "_ref": to}
    link = {"label": "l", "href": "/", "description": "d", "accent": "a"}
    good = [
        ("settings", {"_id": "site-settings", "_type": "siteSettings", "siteName": "s", "footerText": "f", "navigation": [link], "diningPage": {"title": "t", "intro": "i", "seo": {}}, "defaultSeo": {"metaTitle": "x" * 60}}),
        ("home", {"_id": "homepage", "_type": "homePage", "title": "t", "intro": "i", "primaryLinks": [link] * 6, "seo": {}, "featuredGuides": [ref("article-a")]}),
        ("event", {"_id": "event-a", "_type": "event", "language": "es", "slug": slug("a"), "name": "n", "shortDescription": "s", "startDate": "2026-02-28T10:00:00Z", "eventStatus": "scheduled", "venue": ref("place-a")}),
        ("article", {"_id": "article-a", "_type": "article", "language": "es", "slug": slug("a"), "title": "t", "section": "guides", "excerpt": "e", "body": [{"_type": "callout", "text": "x", "tone": "Aviso"}, {"_type": "comparisonTable", "caption": "c", "columns": ["a", ""]}], "publishedAt": "2026-02-28T10:00", "contextLinks": [{"note": "n", "target": ref("beach-a")}]}),
        ("beach", {"_id": "beach-a", "_type": "beach", "language": "es", "slug": slug("a"), "name": "n", "shortDescription": "s", "lengthMeters": 5, "profileContrasts": [{"reason": "r", "beach": ref("beach-b")}]}),
    ]
    assert broken(spark, *good) == set()
    bad = [
        ("settings", {"_id": "other", "_type": "siteSettings", "siteName": " ", "footerText": 3, "navigation": [1], "diningPage": {"title": "t", "seo": {"metaTitle": "x" * 61, "noIndex": "no"}}, "beachesPage": 4, "defaultSeo": None}),
        ("home", {"_id": "homepage", "_type": "homePage", "title": "t", "intro": "i", "primaryLinks": [link] * 5 + [{"label": "l"}], "seo": {}, "featuredGuides": [{"_ref": "x"}], "featuredPlaces": "x"}),
        ("event", {"_id": "event a", "_type": "event", "language": "en", "slug": "a", "name": "n", "shortDescription": "s", "startDate": "2026-02-28", "eventStatus": "soon", "venue": "x", "website": "www.x"}),
        ("article", {"_id": "article-a", "_type": "article", "language": "es", "slug": slug("A"), "title": "t", "section": "guides", "excerpt": "e" * 241, "body": [{"_type": "callout", "tone": "Otro"}, {"_type": "comparisonTable", "columns": ["a"]}, {"_type": "image", "alt": "", "asset": {}}, {"_type": "source", "url": "x", "accessedAt": "2026-02-30"}], "publishedAt": "2026-02-28T10:00", "contextLinks": [{"note": ""}]}),
        ("beach", {"_id": "beach-a", "_type": "beach", "language": "es", "slug": slug("a"), "name": "n", "shortDescription": "s", "lengthMeters": 0, "choiceNote": "", "profileContrasts": {}, "x": [{"y": {"_type": "geopoint", "lat": "1", "lng": 181}}], "r": {"_type": "reference", "_ref": "drafts.x", "_weak": 1}}),
        ("business", {"_id": "b", "_type": "business", "language": "es", "slug": slug("a"), "name": "n", "businessKind": "bar", "shortDescription": "s", "commercialRelationship": None}),
    ]
    assert broken(spark, *bad) == {
        ("settings", "_id", "_id-is"), ("settings", "siteName", "siteName-text"), ("settings", "footerText", "footerText-text"), ("settings", "navigation", "navigation-objects"), ("settings", "diningPage.intro", "intro-text"),
        ("settings", "diningPage.seo.metaTitle", "metaTitle-text-at-most"), ("settings", "diningPage.seo.noIndex", "noIndex-optional-boolean"), ("settings", "beachesPage", "beachesPage-optional-object"), ("settings", "defaultSeo", "defaultSeo-object"),
        ("home", "primaryLinks[5].href", "href-text"), ("home", "primaryLinks[5].description", "description-text"), ("home", "primaryLinks[5].accent", "accent-text"), ("home", "featuredGuides[0]._type", "featuredGuides[]-form"), ("home", "featuredPlaces", "featuredPlaces[]-form"),
        ("event", "_id", "_id-matches"), ("event", "language", "language-is"), ("event", "slug", "slug-object"), ("event", "startDate", "startDate-date-time"), ("event", "eventStatus", "eventStatus-required-one-of"), ("event", "venue", "venue-form"), ("event", "website", "website-optional-web-address"),
        ("article", "slug.current", "current-matches"), ("article", "excerpt", "excerpt-at-most"), ("article", "body[0].tone", "tone-one-of"), ("article", "body[0].text", "text-text"), ("article", "body[1].caption", "caption-text"), ("article", "body[1].columns", "columns-strings"),
        ("article", "body[2].alt", "alt-text"), ("article", "body[2].asset", "asset-reference"), ("article", "body[3].title", "title-matches"), ("article", "body[3].url", "url-web-address"), ("article", "body[3].accessedAt", "accessedAt-optional-date"), ("article", "contextLinks[0].note", "note-text"),
        ("beach", "lengthMeters", "lengthMeters-positive"), ("beach", "choiceNote", "choiceNote-optional-full-text"), ("beach", "profileContrasts", "profileContrasts-optional-list"), ("beach", "x[0].y.lat", "lat-number"), ("beach", "x[0].y.lng", "lng-number"), ("beach", "r._ref", "_ref-matches"), ("beach", "r._weak", "_weak-optional-boolean"),
        ("business", "commercialRelationship", "commercialRelationship-absent"),
    }


def test_rules_of_a_user(spark):
    """A rule set that comes as a table, without code."""
    rules = rule_tables.rules_of(spark.createDataFrame([(None, "a[]", None, "n", "number", "1..3", "warning", "size"), ("t", "", None, "id", "text", None, "error", "id")], rule_tables.RULE))
    docs = [("x", {"_type": "t", "a": [{"n": 1}, {"n": 4}, {"n": "2"}]}), ("y", {"_type": "u", "a": [{"n": 3}]}), ("z", {"_type": "u", "a": [{}]})]
    assert broken(spark, *docs, rules=rules) == {("x", "a[1].n", "size"), ("x", "a[2].n", "size"), ("x", "id", "id"), ("z", "a[0].n", "size")}
    with pytest.raises(ValueError, match="unknown test"):
        rule_tables.rules_of(spark.createDataFrame([(None, None, None, "n", "none", None, "error", "c")], rule_tables.RULE))
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in docs], "id string, json string")
    found = rule_tables.violations(document_rules.walked(df), rules, ["id"])
    assert {tuple(r) for r in rule_tables.outcomes(found, df, "id", F.col("id") != "y").collect()} == {("x", "FAIL", 1, 2), ("y", "SKIPPED", 0, 0), ("z", "WARNING", 0, 1)}
    assert {r.id for r in rule_tables.enforced(df.where("id <> 'x'"), found, "id").collect()} == {"y", "z"}
    with pytest.raises(PySparkException, match="hard errors in x: id"):
        rule_tables.enforced(df, found, "id").collect()


def test_references_and_repeats(spark):
    ref = lambda to, **more: {"_type": "reference", "_ref": to, **more}
    entry = {"_type": "comparisonEntry", "verdict": "v", "strengths": [], "limitations": [], "bestFor": [], "practicalNotes": []}
    doc = {"_id": "comparison-a", "_type": "comparison", "entries": [entry | {"business": ref("business-a")}, entry | {"business": ref("business-b")}, entry | {"business": ref("business-a")}, entry | {"business": ref("business-a")}], "area": ref("business-a"), "soft": ref("gone", _weak=True)}
    docs = spark.createDataFrame([("comparison-a", json.dumps(doc)), ("business-a", '{"_type": "business"}')], "id string, json string")
    nodes = document_rules.walked(docs)
    assert {(r.path, r.code) for r in document_rules.document_issues(nodes).where("code = 'business-unique'").collect()} == {("entries[2].business", "business-unique"), ("entries[3].business", "business-unique")}
    faults = document_rules.reference_faults(document_rules.references(nodes), docs)
    assert {tuple(r) for r in faults.collect()} == {("comparison-a", "entries[1].business", "business-b", "missing"), ("comparison-a", "area", "business-a", "wrong-type")}


def test_a_narrowed_walk_gives_the_same_rows(spark):
    df = spark.createDataFrame([("d", '{"_type": "a", "x": {"_type": "reference", "_ref": "r1", "z": 1.50}, "l": [{"_type": "b", "y": {"_type": "reference", "_ref": "r2"}}, {"_type": "c"}]}'), ("e", "{broken"), ("f", None)], "id string, json string")
    whole = nested.json_walk(df, "json", F.col("id")).where("path is null or type = 'reference' or place = 'l[]' and root_type = 'a'")
    some = nested.json_walk(df, "json", F.col("id"), [(None, None, "reference"), ("a", "l[]", None)], ("_ref", "z"), ("path", "place", "pos", "type", "members"))
    assert some.columns == ["id", "path", "place", "pos", "type", "members"]
    members = lambda m: None if m is None else {k: m[k] for k in m if k in ("_ref", "z")}
    rows = lambda d: sorted(repr((r.id, r.path, r.place, r.pos, r.type, members(r.members))) for r in d.collect())
    assert rows(some) == rows(whole) and some.count() == 5


def test_references_are_read_in_one_walk(spark):
    from cantera import plans

    plan = plans.QUERIES["document_references"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_rules_are_put_to_an_object_once(spark):
    nodes = document_rules.walked(spark.createDataFrame([("d", "{}")], "id string, json string"), rules=document_rules.RULES)
    plan = document_rules.document_issues(nodes, document_rules.RULES[:20])._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("flatten(") > 0 for line in plan.splitlines()) == 1


def test_what_a_walk_clears_breaks_no_rule(spark):
    """Every test on every kind of value, judged for every object and for members in doubt alone."""
    values = ["", " ", "a", "es", " ", "b\n", "ñ", "x" * 9, "2026-02-28", "2026-02-30", "2026-02-28T10:00", "https://x.example", "http://", "12:30", "a..b", 0, 1.50, -3, 1e400, 12345678901234567890, True, False, None, [], [1], ["a"], ["a", " "], ["a", 1], [{}], [{}, "a"], ["a", "b", "c"], {}, {"_type": "reference"}, {"_type": "reference", "_ref": "to"}, {"_type": 1, "_ref": 2}]
    bounds = {"at-most": ["8"], "text-at-most": ["8"], "one-of": ["a|es"], "required-one-of": ["a|es"], "is": ["es"], "optional-is": ["es"], "matches": [r"^[a-z]+$", r"^(?!.*\.\.)[a-z.]{1,5}$", r"(?i)^HTTPS?://[^\s/?#]+", r"^[a-z&&[^b]]+$", r"\p{L}", "^([01]\\d|2[0-3]):[0-5]\\d$"], "number": ["-3..2", "..0"], "list": [None, "1..2"], "texts": [None, "3.."], "strings": [None, "..1"]}
    bounds |= {"optional-matches": bounds["matches"], "optional-number": bounds["number"], "optional-list": [None], "optional-texts": [None]}
    rules = [(None, where, None, "v", test, bound, "error", f"{test} {bound} {where}") for test in rule_tables.TESTS for bound in bounds.get(test, [None]) for where in ("", "l[]")]
    rules += [("t", None, "n", "w", "text", None, "warning", "typed")]
    docs = [(f"d{k}", json.dumps({"_type": "t", "v": v, "l": [{"_type": "n", "v": v}, {"w": 1}, {"v": v, "w": "x"}]})) for k, v in enumerate(values)] + [("none", "{}"), ("list", '[{"v": 1}]'), ("bad", "{"), ("null", None), ("twice", '{"l": [{"v": "a"}, {"v": 1}, {"v": "a"}, {"v": 1}]}')]
    df = spark.createDataFrame(docs, "id string, json string")
    found = lambda d: sorted(map(repr, d.collect()))
    want = found(document_rules.document_issues(document_rules.walked(df), rules))
    assert found(rule_tables.issues(df, rules)) == want and len(want) > 1000
    # What is cleared leaves no row.
    doubts = lambda made: nested.json_doubts(df, "json", F.col("id"), [(*r[:4], made(r)) for r in rules]).count()
    assert doubts(lambda r: lambda: rule_tables.cleared(*r[4:6])) < doubts(lambda r: lambda: lambda v: False)


def test_documents_without_faults_leave_no_rows(spark):
    text = json.dumps({"_id": "business-1", "_type": "business", "language": "es", "slug": slug("a"), "name": "n", "businessKind": "bar", "shortDescription": "s", "website": "https://x.example", "categories": [{"_type": "reference", "_ref": "category-1"}], "lastVerified": "2026-01-01"})
    rules = [(*r[:4], lambda r=r: rule_tables.cleared(*r[4:6])) for r in document_rules.RULES]
    assert nested.json_doubts(spark.createDataFrame([("business-1", text)], "id string, json string"), "json", F.col("id"), rules).count() == 0


def test_what_has_to_be_unique_is_told_where_documents_are_walked(spark):
    """By document, also if two have one id; nothing is shuffled, and only what is repeated leaves the walk."""
    rules = [(None, "l[].k[]", None, "v", "unique", None, "error", "v"), (None, "o", None, "v", "unique", None, "error", "o")]
    one = {"o": {"v": "a"}, "l": [{"k": [{"v": "a"}, {"v": "b"}, {"v": 1}]}, {"k": [{"v": "b"}, {"v": {"_ref": "a"}}, {"v": "1"}, {"v": None}, {}]}]}
    df = spark.createDataFrame([("d", json.dumps(one)), ("e", json.dumps({"l": [{"k": [{"v": "a"}]}]})), ("f", json.dumps({"o": {"v": "a"}}))], "id string, json string")
    found = rule_tables.issues(df, rules)
    # Of equal texts, the first in its list stays: "b" of the second list is the first there.
    assert sorted((r.id, r.path) for r in found.collect()) == [("d", "l[0].k[1].v"), ("d", "l[1].k[1].v"), ("d", "l[1].k[2].v")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert rule_tables.issues(df.select(F.lit("d").alias("id"), "json"), rules).count() == 3
