"""Folder scans, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cantera.operators import discovery, quality, reports
from cantera.sources import cache, files, sinks
from cantera.streaming import runs

SCHEMA = StructType([StructField("_id", StringType()), StructField("n", LongType())])


def test_json_scan(spark, tmp_path):
    assert files.json_documents(spark, str(tmp_path / "absent"), SCHEMA).count() == 0
    (tmp_path / "a.json").write_text(json.dumps({"_id": "a", "n": 1}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.txt").write_text("{}")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.json").write_text('{"_id": "d"}')
    flat = files.json_documents(spark, str(tmp_path), SCHEMA).cache()
    assert {(r._id, r.state) for r in flat.collect()} == {("a", "available"), (None, "invalid")}
    assert files.json_documents(spark, str(tmp_path), SCHEMA, recursive=True).count() == 3


def test_changed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    before = spark.createDataFrame(files.listing(spark, str(tmp_path)).collect(), "path string, modified timestamp, size bigint")
    (tmp_path / "b.json").write_text("{}")
    assert [r.path.rsplit("/", 1)[1] for r in files.changed_files(files.listing(spark, str(tmp_path)), before).collect()] == ["b.json"]


def test_site_scan(spark, tmp_path):
    (tmp_path / "guia").mkdir()
    (tmp_path / "index.html").write_text("<p>home")
    (tmp_path / "guia" / "index.html").write_text("<p>guide")
    (tmp_path / "404.html").write_text("<p>none")
    assert sorted(r.route for r in files.html_pages(spark, str(tmp_path)).collect()) == ["/", "/404.html", "/guia/"]
    (tmp_path / "sitemap-0.xml").write_text("<loc>https://x/a/</loc><loc> https://x/b/ </loc><loc>https://x/s.xml</loc>")
    assert sorted(r.url for r in files.sitemap_urls(spark, str(tmp_path / "*.xml")).collect()) == ["https://x/a/", "https://x/b/"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(sinks.create_or_replace(old, new, "k")) == [("a", 1), ("b", 2), ("c", 2)]
    assert rows(sinks.create_if_absent(old, new, "k")) == [("a", 1), ("b", 1), ("c", 2)]
    staged = spark.createDataFrame([("a", 9, "FAIL"), ("d", 9, "WARNING")], "k string, v int, outcome string")
    assert rows(sinks.promote(staged, old, "k")) == [("b", 1), ("d", 9)]
    assert rows(sinks.append_claims(old, new.unionByName(new), ["k"])) == [("c", 2)]
    path = str(tmp_path / "t")
    assert sinks.replace_if(old, path, True) and not sinks.replace_if(new, path, False)
    assert rows(spark.read.parquet(path)) == rows(old)
    a, b = (spark.createDataFrame([(1, v)], "x int, y string").select(sinks.plan_hash(x=F.col("x"), y=F.col("y")).alias("h")).first().h for v in ("p", None))
    assert a != b and len(a) == 64
    row = spark.createDataFrame([(1, "p")], "x int, y string")
    assert row.select(sinks.plan_hash(y=F.col("y"), x=F.col("x")).alias("h")).first().h == a


def test_failed_write_keeps_the_old_table(spark, tmp_path):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    path = str(tmp_path / "t")
    assert sinks.replace_if(old, path, True)
    bad = old.withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        sinks.replace_if(bad, path, True)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("a", 1)]
    assert sinks.replace_if(old.withColumn("v", F.lit(2)), path, True)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("a", 2)] and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_documents_by_type(spark, tmp_path):
    schema = StructType([StructField("_id", StringType()), StructField("_type", StringType())])
    for kind, name, body in (("a", "1", '{"_id": "1", "_type": "a"}'), ("a", "2", '{"_id": "2", "_type": "b"}'), ("b", "3", "{"), ("b", "4", '{"_id": "4", "_type": "b"}')):
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / f"{name}.json").write_text(body)
    good, issues = files.typed_documents(spark, {k: str(tmp_path / k) for k in ("a", "b", "absent")}, schema)
    assert sorted(r._id for r in good.collect()) == ["1", "4"]
    assert sorted((r.path[-6:], r.code) for r in issues.collect()) == [("2.json", "type"), ("3.json", "unreadable")]
    docs = files.json_documents(spark, str(tmp_path / "b"), schema).cache()
    wanted = spark.createDataFrame([("3.json",), ("4.json",), ("5.json",)], "name string")
    assert {tuple(r) for r in files.states(docs, wanted).collect()} == {("3.json", "invalid"), ("4.json", "available"), ("5.json", "missing")}
    assert [tuple(r) for r in files.json_or(spark, str(tmp_path / "none.json"), schema, [("x", "y")]).collect()] == [("x", "y")]
    assert files.json_or(spark, str(tmp_path / "a" / "1.json"), schema, []).first()._id == "1"
    assert [r.path for r in files.relative_paths(spark, str(tmp_path)).collect()] == ["a/1.json", "a/2.json", "b/3.json", "b/4.json"]


def test_index_merge(spark):
    schema = "path string, modified int, size int, state string, name string"
    index = spark.createDataFrame([("a", 1, 1, "available", "A"), ("b", 1, 1, "available", "B"), ("c", 1, 1, "available", "C")], schema)
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, modified int, size int")
    assert sorted(r.path for r in files.changed_files(now, index.select("path", "modified", "size")).collect()) == ["b", "d"]
    parsed = spark.createDataFrame([("b", 2, 1, "invalid", None), ("d", 1, 1, "available", "D")], schema)
    rows, warnings = files.merged_index(index, parsed, now)
    assert sorted((r.path, r.name) for r in rows.collect()) == [("a", "A"), ("b", None), ("d", "D")]
    assert [tuple(r) for r in warnings.collect()] == [("b", "invalid")]


def test_map_extract_and_manual_rows(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 38.5, "lon": -0.1, "tags": {"amenity": "bar", "name": "B"}}, {"type": "way", "id": 2, "center": {"lat": 38.5, "lon": -0.1}, "tags": {"shop": "x", "name": "S"}}, {"type": "area", "id": 3}, {"type": "node", "tags": {}}]}))
    records = discovery.normalised(files.map_elements(spark, str(tmp_path / "x.json")))
    found, status = files.extract_run(records, ["bar"], (38.0, -1.0, 39.0, 0.0))
    assert [r.identifier for r in found.collect()] == ["node/1"] and status == "completed"
    assert files.extract_run(records, ["hotel"], (38.0, -1.0, 39.0, 0.0))[1] == "anomalous-empty"
    (tmp_path / "m.json").write_text('[{"name": "a", "type": "bar"}, {"name": " ", "type": "bar"}]')
    rows = files.manual_rows(spark, str(tmp_path / "m.json"), "name: string, type: string", ["type"])
    assert [(r.ord, r.name) for r in rows.collect()] == [(0, "a"), (1, " ")]
    with pytest.raises(Exception, match="row 1 lacks name"):
        files.manual_rows(spark, str(tmp_path / "m.json"), "name: string, type: string", ["name", "type"]).collect()


def test_sitemap_index(spark, tmp_path):
    (tmp_path / "sitemap-index.xml").write_text("<loc>https://x/sitemap-0.xml</loc>")
    (tmp_path / "sitemap-0.xml").write_text("<loc>https://x/a/</loc><loc> https://x/b/ </loc>")
    (tmp_path / "sitemap-old.xml").write_text("<loc>https://x/old/</loc>")
    assert sorted(r.url for r in files.indexed_sitemap_urls(spark, str(tmp_path)).collect()) == ["https://x/a/", "https://x/b/"]


def test_cache(spark):
    rows = [("f", 1, "2026-01-01 00:00:00", "old"), ("f", 1, "2026-01-03 00:00:00", "new"), ("g", 2, "2026-01-03 00:00:00", "other version"), ("h", 1, "2026-02-03 00:00:00", "from the future"), ("i", 1, "2025-01-01 00:00:00", "too old")]
    table = spark.createDataFrame(rows, "fingerprint string, version int, stored string, result string").withColumn("stored", F.col("stored").cast("timestamp"))
    wanted = spark.createDataFrame([(k,) for k in "fghij"], "fingerprint string")
    got = {r.fingerprint: r.result for r in cache.load(wanted, table, "2026-01-05 00:00:00", 7).collect()}
    assert got == {"f": "new", "g": None, "h": None, "i": None, "j": None}
    saved = cache.save(table, spark.createDataFrame([("f", "made")], "fingerprint string, result string"), "2026-01-05 00:00:00")
    assert {r.fingerprint: r.result for r in cache.load(wanted, saved, "2026-01-06 00:00:00", 7).collect()}["f"] == "made" and saved.count() == 4


def test_reports_and_manifest(spark):
    out = spark.createDataFrame([("PASS",), ("PASS",), ("FAIL",)], "outcome string")
    assert [tuple(r) for r in sinks.phase_report(out, ["PASS", "WARNING", "FAIL"]).collect()] == [("PASS", 2), ("WARNING", 0), ("FAIL", 1), ("total", 3)]
    old = spark.createDataFrame([("t", "select", "PASS", False), ("t", "enrich", "PASS", False), ("t", "qa", "PASS", False), ("u", "qa", "PASS", False)], "topic string, phase string, outcome string, stale boolean")
    new = spark.createDataFrame([("t", "enrich", "FAIL")], "topic string, phase string, outcome string")
    rows = {(r.topic, r.phase): (r.outcome, r.stale) for r in sinks.record_phase(old, new, ["select", "enrich", "qa"]).collect()}
    assert rows == {("t", "select"): ("PASS", False), ("t", "enrich"): ("FAIL", False), ("t", "qa"): ("PASS", True), ("u", "qa"): ("PASS", False)}
    m = sinks.manifest(spark.createDataFrame([("b", 1, "x"), ("a", 1, "x")], "id string, v int, updated string"), spark.createDataFrame([("b", 2)], "id string, v int"), "now")
    assert [tuple(r) for r in m.collect()] == [("a", 1, "now"), ("b", 2, "now")]
    assert sinks.accepted(out).count() == 2
    table = spark.createDataFrame([("a|b", 2), (None, 1)], "k string, n int")
    assert [r.x for r in table.select(reports.markdown_table(table).alias("x")).collect()] == ["| a\\|b | 2 |", "|  | 1 |"]


def test_fact_and_map_merges(spark):
    df = spark.sql("select named_struct('value', 'x', 'sources', array('osm')) as a, named_struct('value', 'x', 'sources', array('web', 'osm')) as b, named_struct('value', 'z', 'sources', array('web')) as c, cast(null as struct<value:string,sources:array<string>>) as d")
    get = lambda p, q: df.select(quality.merge_facts(F.col(p), F.col(q)).alias("m")).first().m
    assert get("a", "b").sources == ["osm", "web"] and get("a", "c").value == "x" and get("d", "c").value == "z" and get("a", "d").value == "x"
    m = spark.sql("select map('a', '1', 'b', '2') as x, map('b', '3', 'c', null) as y").select(quality.merge_maps(F.col("x"), F.col("y")).alias("m")).first().m
    assert m == {"a": "1", "b": "3", "c": None}


def test_issues_and_outcome(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 50, "x"), (3, None, "x")], "id int, n int, t string")
    found = quality.issues(df, "id", {"BIG": F.col("n") > 10, "EMPTY": F.col("t").isNull()})
    assert sorted(map(tuple, found.collect())) == [(1, "EMPTY"), (2, "BIG")]
    assert {tuple(r) for r in quality.outcome(found, df, "id", {"EMPTY": 1}).collect()} == {(1, "WARNING"), (2, "FAIL"), (3, "PASS")}


def test_upsert_stream(spark, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "out")
    part = lambda rows: spark.createDataFrame(rows, "k string, ts int").coalesce(1).write.mode("append").parquet(landing)
    stream = lambda: runs.upsert_stream(runs.landed(spark, landing, "k string, ts int", 1), root, "k", "ts", "string", "int", 3).awaitTermination(120)
    now = lambda: sorted(map(tuple, runs.catalogue(spark, root, "k", "string", "int").collect()))
    kept = lambda: sorted(p.name for p in (tmp_path / "out").iterdir() if p.name[:4] in ("base", "delt"))
    assert now() == []
    part([("a", 3), ("a", 1)])
    stream()
    part([("a", 7), ("b", 2)])
    stream()
    assert now() == [("a", 1, 7, 3), ("b", 2, 2, 1)] and kept() == ["delta-0", "delta-1"]
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / "out" / name).glob("*.parquet"))
    part([(f"k{k}", k) for k in range(5000)])
    stream()
    assert kept() == ["base-2", "delta-0", "delta-1", "delta-2"] and len(now()) == 5002
    for k in range(3):
        part([("a", 100 + k)])
        stream()
    assert size("delta-5") * 10 < size("base-2")
    assert kept() == ["base-2", "base-5", "delta-3", "delta-4", "delta-5"] and ("a", 1, 102, 6) in now()
    # A batch that runs again, before or after it is compacted, counts once.
    for commits in ((tmp_path / "out/checkpoint/commits").iterdir(),):
        for p in commits:
            if p.name.lstrip(".").startswith("5"):
                p.unlink()
    stream()
    assert ("a", 1, 102, 6) in now() and len(now()) == 5002


def test_windowed_log_counts(spark, tmp_path):
    landing = str(tmp_path / "logs")
    spark.sql("select timestamp'2024-01-01 00:01:00' as ts, 'info' as level union all select timestamp'2024-01-01 00:02:00', 'info' union all select timestamp'2024-01-01 00:07:00', 'error'").write.parquet(landing)
    logs = runs.landed(spark, landing, "ts timestamp, level string")
    q = runs.phase_counts(logs).writeStream.format("memory").queryName("log_counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.level, r.n) for r in spark.table("log_counts").collect()) == [("error", 1), ("info", 2)]


def test_stored_frames_are_computed_once(spark):
    from cantera.sources.store import shared_folder, stored

    n = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    df = stored(spark.range(50).mapInArrow(count, "id bigint"), "once")
    assert (df.count(), df.where("id > 10").count(), n.value) == (50, 39, 50)
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint"]
