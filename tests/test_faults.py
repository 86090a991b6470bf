"""Answers that were wrong once."""

import pytest
from pyspark.sql import functions as F

from cantera.functions import extract
from cantera.operators import audit, quality
from cantera.sources import sinks


def test_false_and_empty_lists_are_not_useful(spark):
    df = spark.createDataFrame([(True, ["a"], "false", ["s"]), (False, [], "[]", ["s"]), (None, None, None, ["s"])], "b boolean, l array<string>, t string, s array<string>")
    got = df.select(*[quality.useful(F.col(c), F.col("s")).alias(c) for c in "blt"]).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, True), (False, False, False)]


def test_tags_say_true_and_false(spark):
    df = spark.createDataFrame([(v,) for v in ("true", "FALSE", "Only", "no", "1", None)], "v string")
    assert [r.b for r in df.select(extract.tag_boolean(F.col("v")).alias("b")).collect()] == [True, False, True, False, None, None]


def test_quoted_angles_do_not_end_tags(spark):
    html = '<a title="a>b" href="/z/">x</a><a href=\'/y/\' data-x=\'>\'><a href="/open>q</a><a>'
    df = spark.createDataFrame([(html,), ("<a " + "x='>' " * 20_000 + "href='/long/'>",)], "html string")
    got = [r.t for r in df.select(audit.tags(F.col("html"), "a").alias("t")).collect()]
    assert got[0] == ['<a title="a>b" href="/z/">', "<a href='/y/' data-x='>'>", '<a href="/open>', "<a>"]
    assert len(got[1]) == 1 and got[1][0].endswith("href='/long/'>")


def test_name_of_the_signals_tag(spark):
    page = "<html><head><meta name='my-signals' content='{\"kind\": \"beach\"}'></head><body></body></html>"
    df = spark.createDataFrame([(1, "https://x.example/", page)], "page_id int, url string, html string")
    assert audit.parse(df, signals_meta="my-signals").first().signals.kind == "beach"
    assert audit.parse(df).first().signals is None


def test_duplicates_name_all_others(spark):
    rows = [(k, "h", f"/p{k:02}/", "indexable", "same") for k in range(25)] + [(90, "h", "/x/", "noindex", "same"), (91, "i", "/y/", "indexable", "same"), (92, "h", "/z/", "indexable", None)]
    df = spark.createDataFrame(rows, "page_id int, host string, route string, type string, title string")
    got = {r.page_id: r.detail for r in audit.duplicate_findings(df, "title").collect()}
    assert set(got) == set(range(25))
    assert got[3] == "25 " + ",".join(f"/p{k:02}/" for k in range(21) if k != 3)
    assert {r.page_id: r.detail for r in audit.duplicate_findings(df.where("page_id in (1, 2)"), "title").collect()} == {1: "2 /p02/", 2: "2 /p01/"}


def test_failed_rename_keeps_the_old_table(spark, tmp_path, monkeypatch):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    path = str(tmp_path / "t")
    assert sinks.replace_if(old, path, True)
    files = sinks._files

    def failing(session, at):
        name, context, rename = files(session, at)

        def some(a, b):
            if ".new-" in a:
                raise OSError("no rename")
            rename(a, b)

        return name, context, some

    monkeypatch.setattr(sinks, "_files", failing)
    with pytest.raises(OSError, match="no rename"):
        sinks.replace_if(old.withColumn("v", F.lit(2)), path, True)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("a", 1)]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
