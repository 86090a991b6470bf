"""Operators on small inputs: boundaries, ties, nulls, order of rows."""

import datetime
import hashlib
import pathlib
import random

from pyspark.sql import functions as F

from cantera.functions import dates, extract, geo, text, urls
from cantera.functions.geo import inside_polygons
from cantera.functions.text import decode_entities
from cantera.operators import aggregates, audit, dedup, graph, joins, lifecycle, links, pairs, quality, selection, validation

ROOT = pathlib.Path(__file__).resolve().parent.parent


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


def test_fold(spark):
    f = text.fold(F.col("t"))
    assert one(spark, f, t="  Menú  del\tDÍA — 12,50 €") == "menu del dia 12 50"
    assert one(spark, f, t="ñandú") == "nandu"
    assert one(spark, f, t="mençáo") == "mencao"
    assert one(spark, f, t=None) is None


def test_slug_and_phrase(spark):
    assert one(spark, text.slugify(F.col("t")), t="¡Café Ñu!") == "cafe-nu"
    assert one(spark, text.slugify(F.col("t")), t="—") == "sin-nombre"
    hit = text.contains_phrase(F.col("t"), F.col("p"))
    assert one(spark, hit, t="arroz a banda", p="a banda") is True
    assert one(spark, hit, t="arroz a bandada", p="a banda") is False
    assert one(spark, hit, t="x", p="") is False


def test_html_to_text(spark):
    x = text.html_to_text(F.col("h"))
    assert one(spark, x, h="<style>p{}</style><p>a&nbsp;&lt;b&gt; &amp;amp;</p><!-- c --><script>1</script>") == "a <b> &amp;"


def test_urls(spark):
    assert one(spark, urls.canonical_url(F.col("u")), u="HTTPS://Www.X.com/a?utm_source=z&b=2&a=1#f") == "https://www.x.com/a?a=1&b=2"
    assert one(spark, urls.source_key(F.col("u")), u="http://www.x.com/es/a/") == one(spark, urls.source_key(F.col("u")), u="https://x.com/a")


def test_strict_dates(spark):
    d = dates.strict_date(F.col("t"))
    assert one(spark, d, t="2024-02-29") == datetime.date(2024, 2, 29)
    for bad in ("2023-02-29", "2024-2-3", "2024-02-03T00", None):
        assert one(spark, d, t=bad) is None
    rows = spark.createDataFrame([(90,), (91,), (None,)], "age int").select(dates.is_stale(F.col("age")).alias("s")).collect()
    assert [r.s for r in rows] == [False, True, True]


def test_geometry(spark):
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]
    df = spark.createDataFrame([(3.0, 3.0), (1.5, 1.5), (5.0, 1.0), (None, 1.0)], "lat double, lng double")
    assert [r.i for r in df.select(geo.inside_polygon(F.col("lat"), F.col("lng"), square).alias("i")).collect()] == [True, False, False, False]
    d = spark.range(1).select(geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")).first().d
    assert abs(d - 111194.93) < 1


def test_dedup_does_not_depend_on_row_order(spark):
    rows = [("a", 3, 1, "x"), ("a", 1, 5, "y"), ("b", 2, 0, "x"), ("a", 2, 9, "y")]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k string, ord int, v int, tag string")
        first = tuple(sorted(map(tuple, dedup.first_wins(df, ["k"], [F.col("ord")]).select("k", "ord", "v").collect())))
        last = tuple(sorted(map(tuple, dedup.last_wins(df, "k", "v", "ord").collect())))
        merged = tuple(sorted((r.k, r.position, tuple(r["items"])) for r in dedup.merged(df, "k", "tag", "ord").collect()))
        seen.add((first, last, merged))
    assert seen == {((("a", 1, 5), ("b", 2, 0)), (("a", 1, 1), ("b", 0, 2)), (("a", 1, ("y", "x")), ("b", 2, ("x",))))}


def test_slugs_and_fingerprints(spark):
    df = spark.createDataFrame([("k1", "Bar A"), ("k2", "bar á"), ("k3", "C")], "key string, name string")
    got = {r.key: r.slug for r in dedup.unique_slugs(df, "name", "key").collect()}
    assert got["k1"] == "bar-a" and got["k3"] == "c" and got["k2"].startswith("bar-a-") and len(got["k2"]) == 12
    ids = {r.unique_id for r in dedup.occurrence_ids(spark.createDataFrame([("e", 1), ("e", 2)], "k string, o int"), "k", [F.col("o")]).collect()}
    assert ids == {"e", "e~2"}


def test_selection_keeps_the_overflow(spark):
    df = spark.createDataFrame([(i, "arroz a banda" if i < 5 else "pizza", 1) for i in range(8)], "id int, body string, extra int")
    got = selection.select_topic(df, "id", "body", ["arroz", "arroz a banda"], {"extra": 5.0}, 3).collect()
    assert sorted((r.id, r.outcome) for r in got if r.outcome != "no match") == [(0, "selected"), (1, "selected"), (2, "selected"), (3, "over limit"), (4, "over limit")]
    assert {tuple(r.terms) for r in got if r.outcome == "selected"} == {("arroz a banda",)}
    assert sum(r.outcome == "no match" for r in got) == 3


def test_references(spark):
    a = spark.createDataFrame([(1, [3, 2, 9]), (2, None)], "id int, refs array<int>")
    b = spark.createDataFrame([(2, "two"), (3, "three")], "key int, name string")
    got = {r.id: r.names for r in joins.deref_array(a, "id", "refs", b, "key", "name", "names").collect()}
    assert got == {1: ["three", "two"], 2: []}
    assert [r.ref for r in joins.unresolved(spark.createDataFrame([(2,), (7,), (None,)], "ref int"), "ref", b, "key").collect()] == [7]


def test_radius_matches_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, 38.5 + rnd.random() / 20, -0.1 + rnd.random() / 20) for i in range(80)]
    df = spark.createDataFrame(pts, "id int, lat double, lng double")
    got = {(r.a_id, r.b_id) for r in joins.within_radius(df, df, 400.0).collect()}
    every = df.alias("a").join(df.alias("b"), F.col("a.id") < F.col("b.id")).filter(geo.haversine_m(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")) <= 400.0)
    assert got and got == {(r[0], r[1]) for r in every.select("a.id", "b.id").collect()}


def test_pairs_match_brute_force(spark):
    rnd = random.Random(4)
    sets = [(i, sorted({f"w{rnd.randint(0, 12)}" for _ in range(rnd.randint(1, 8))})) for i in range(60)]
    df = spark.createDataFrame(sets, "key int, tokens array<string>")
    got = {(r.a, r.b): round(r.jaccard, 9) for r in pairs.jaccard_pairs(df, df, 0.6).filter("a < b").collect()}
    want = {}
    for a, x in sets:
        for b, y in sets:
            if a < b and (j := len(set(x) & set(y)) / len(set(x) | set(y))) >= 0.6:
                want[a, b] = round(j, 9)
    assert got == want


def test_coverage_and_facts(spark):
    domain = spark.createDataFrame([("a",), ("b",)], "k string")
    counts = spark.createDataFrame([("a", 2)], "k string, n bigint")
    assert {tuple(r) for r in aggregates.zero_filled(counts, domain, "k").collect()} == {("a", 2), ("b", 0)}
    claims = spark.createDataFrame([("f", "1", 1), ("f", "2", 2), ("g", "1", 1), ("g", "1", 3)], "fact string, v string, rank int")
    got = {r.fact: (r.status, r.best_value) for r in aggregates.resolve_facts(claims, ["fact"], "v", [F.desc("rank")]).collect()}
    assert got == {"f": ("conflict", "2"), "g": ("confirmed", "1")}


def test_lifecycle(spark):
    old = spark.createDataFrame([("a", 1, 2, 2), ("b", 1, 1, 1)], "k string, first_seen int, last_seen int, n bigint")
    new = spark.createDataFrame([("a", 5), ("c", 6), ("c", 7)], "k string, ts int")
    got = {r.k: tuple(r)[1:] for r in lifecycle.upsert(old, new, "k", "ts").collect()}
    assert got == {"a": (1, 5, 3, "seen again"), "b": (1, 1, 1, "not seen"), "c": (6, 7, 2, "new")}
    p = spark.createDataFrame([(3, 2, 1), (1, 2, 3), (5, 1, 2)], "a int, b int, c int")
    flags = {(r.a, r.b, r.c): (r.b_stale, r.c_stale) for r in lifecycle.phase_staleness(p, ["a", "b", "c"]).collect()}
    assert flags == {(3, 2, 1): (True, True), (1, 2, 3): (False, False), (5, 1, 2): (True, True)}


def test_internal_targets(spark):
    rows = [("/a?b#c", "/a/"), ("b", "/x/b/"), ("../b/./c.html", "/b/c.html"), ("../../../d/", "/d/"), ("", None), ("#x", None), ("mailto:a@b", None), ("//other.org/", None), ("//site.org", "/"), ("HTTPS://Site.org/q", "/q/"), ("http://site.org/", None), ("/f.pdf", None), ("?q=1", "/x/"), ("..", "/")]
    df = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(rows)], "k int, href string")
    got = df.select("k", audit.internal_target(F.col("href"), F.lit("/x/"), F.lit("https"), F.lit("site.org")).alias("t")).collect()
    assert {rows[r.k][0]: r.t for r in got} == dict(rows)


def test_entities(spark):
    rows = {"a &amp; b": "a & b", "&#233;&#xE9;&#x1F600;!": "éé😀!", "&#0;&#xD800; &#99999999;": "&#0;&#xD800; &#99999999;", "&eacute;&nbsp;x": "&eacute; x", "&#39&lt;": "&#39<", "plain": "plain"}
    df = spark.createDataFrame([(k,) for k in rows], "t string").select("t", decode_entities(F.col("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == rows


def test_ordered_findings_and_proposals(spark):
    f = spark.createDataFrame([("/b", "x", None, "1"), ("/a", "y", "menu", "1"), ("/a", "y", None, "2"), ("/Z", "x", None, "0")], "route string, rule string, zone string, detail string")
    assert [tuple(r) for r in audit.ordered(f).collect()] == [("/Z", "x", None, "0"), ("/a", "y", None, "2"), ("/a", "y", "menu", "1"), ("/b", "x", None, "1")]
    p = spark.createDataFrame([("b", "z", "misma-zona", False), ("a", "z", "hub-ficha", False), ("c", "y", "ficha-hub", True), ("a", "z", "ficha-hub", False)], "src string, dst string, reason string, below boolean")
    assert [r.src + r.reason for r in links.ordered(p).collect()] == ["cficha-hub", "ahub-ficha", "aficha-hub", "bmisma-zona"]
    items = spark.createDataFrame([("/a/?x",), ("https://o/",), ("//o/",), ("/b/",)], "href string")
    assert sorted(r.href for r in links.keep_known(items, "href", spark.createDataFrame([("/a/",)], "route string"), "route").collect()) == ["//o/", "/a/?x", "https://o/"]


def test_fingerprints_and_slugs(spark):
    rows = spark.createDataFrame([(1, "bar", "A", None, 1.0), (2, "bar", "A", None, 1.0), (3, "bar", "Á", 38.123456, -0.1)], "k int, t string, n string, lat double, lng double")
    got = [r.f for r in rows.select(dedup.fingerprint(F.col("t"), F.col("n"), F.col("lat"), F.col("lng")).alias("f")).collect()]
    assert got == [None, None, "bar:a:38.12346,-0.10000"]
    taken = "sol-" + hashlib.sha1(b"2").hexdigest()[:6]
    names = spark.createDataFrame([(1, "Sol"), (2, "sol"), (3, taken)], "k int, n string")
    slugs = {r.k: r.slug for r in dedup.unique_slugs(names, "n", "k").collect()}
    assert slugs == {1: "sol", 2: taken + "~2", 3: taken}


def test_radius_anywhere(spark):
    places = [("a", 80.0, 10.0), ("b", 80.0, 10.004), ("c", 10.0, 179.9999), ("d", 10.0, -179.9999), ("e", -45.0, 20.0), ("f", -45.0007, 20.0), ("g", 89.99, 0.0), ("h", 89.99, 120.0), ("i", 0.0, 0.002)]
    df = spark.createDataFrame(places, "id string, lat double, lng double")
    got = {(r.a_id, r.b_id) for r in joins.within_radius(df, df, 100).collect()}
    assert got == {("a", "b"), ("c", "d"), ("e", "f")}
    assert {(r.a_id, r.b_id) for r in joins.within_radius(df, df, 3000).collect()} >= {("g", "h")}


def test_multipolygon(spark):
    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    shapes = [[square(0, 0, 4), square(1, 1, 1)], [square(10, 10, 2)]]
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (11.0, 11.0), (6.0, 6.0), (None, 1.0)], "lat double, lng double")
    assert [r.x for r in df.select(inside_polygons(F.col("lat"), F.col("lng"), shapes).alias("x")).collect()] == [True, False, True, False, False]


def test_order_of_lists(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a", "b"], ["b"]), ([], [])], "x array<string>, y array<string>")
    assert [r.d for r in df.select(validation.order_mismatch(F.col("x"), F.col("y")).alias("d")).collect()] == [[], [0, 1], []]


def test_external_facts(spark):
    df = spark.createDataFrame([(["brand"], ["third-party"], "confirmed"), (["establishment"], ["third-party"], "mismatch"), (["establishment"], ["third-party"], "ambiguous"), (["establishment"], ["open-data"], "ambiguous"), (["establishment"], ["third-party"], "confirmed")], "s array<string>, c array<string>, o string")
    got = [r.x for r in df.select(validation.external_acceptance(F.col("s"), F.col("c"), F.col("o")).alias("x")).collect()]
    assert got == ["BRAND_SCOPE_NOT_LOCAL", "IDENTITY_MISMATCH", "AMBIGUOUS_EXTERNAL_IDENTITY", None, None]


def test_text_cuts(spark):
    text = "La sala grande mira al mar desde la primera planta del edificio, y la terraza cubierta cierra en invierno. Otra cosa."
    df = spark.createDataFrame([(text, ["Terraza cubierta cerrada en invierno"]), (text, []), ("corto, terraza cubierta", ["terraza cubierta"])], "t string, o array<string>")
    got = [r.x for r in df.select(extract.without_repeats(F.col("t"), F.col("o")).alias("x")).collect()]
    assert "invierno" not in got[0] and got[0].startswith("La sala") and got[1:] == [text, "corto, terraza cubierta"]
    ex = df.select(extract.excerpt(F.col("t"), F.lit("ÓTRA")).alias("e")).first().e
    assert ex == "Otra cosa."
    tags = spark.createDataFrame([("pizza;local_food, x", "yes"), (None, "NO"), ("", "maybe")], "v string, b string").select(extract.tag_list(F.col("v")).alias("l"), extract.tag_boolean(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in tags] == [(["pizza", "local food", "x"], True), (None, False), ([], None)]


def test_useful_values(spark):
    df = spark.createDataFrame([("x", ["s"]), (" ", ["s"]), ("x", []), ("x", None), (None, ["s"])], "v string, s array<string>")
    assert [r.u for r in df.select(quality.useful(F.col("v"), F.col("s")).alias("u")).collect()] == [True, False, False, False, False]


def test_quoted_hours(spark):
    df = spark.createDataFrame([("09:00-14:30", "de 9:00 a 14:30"), ("09:00-14:30", "de 9:00"), ("10:00", "110:00")], "v string, q string")
    assert [r.x for r in df.select(extract.quoted_hours(F.col("v"), F.col("q")).alias("x")).collect()] == [True, False, False]


def test_no_present_time_in_semantics():
    for p in (ROOT / "cantera").rglob("*.py"):
        assert "current_timestamp" not in p.read_text() and "current_date" not in p.read_text(), p


def test_totals_of_maps(spark):
    rows = [("a", {"x": 1.0, "y": None}, {"p": 2}), ("a", {"x": 2.0}, None), ("b", None, None), (None, {"z": 1.0}, {"p": 1})]
    df = spark.createDataFrame(rows, "g string, m map<string,double>, n map<string,int>")
    got = {r.g: (r.m, r.n) for r in aggregates.map_totals(df, ["g"], {"m": ["x", "w"], "n": None}).collect()}
    assert got == {"a": ({"x": 3.0, "y": 0.0, "w": 0.0}, {"p": 2.0}), "b": ({"x": 0.0, "w": 0.0}, {}), None: ({"x": 0.0, "w": 0.0, "z": 1.0}, {"p": 1.0})}
    assert [tuple(r) for r in spark.createDataFrame([(0, 3), (2, 3), (None, None)], "a int, b int").select(aggregates.first_nonzero(F.col("a"), F.col("b"))).collect()] == [(3,), (2,), (0,)]
