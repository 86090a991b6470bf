"""Queries over tables made for one case each, against their SQL."""

import hashlib
from collections import Counter

import duckdb

from cantera import plans
from cantera.functions.html import elements, spelled
from cantera.operators import pairs


def same(spark, folder, name, **tables):
    """The query's rows, which have to be those of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = plans.QUERIES[name](spark, str(folder))
    got = [tuple(r) for r in df.collect()]
    assert Counter(got) == Counter(con.execute(f"select {', '.join(df.columns)} from ({plans.ORACLES[name]})").fetchall())
    return got


def test_references_without_semicolon(spark, tmp_path):
    heads = ["a &amp;&amp; b&amp", "&am c&quot;", "&amp;lt; &copy &nope; &#39; &Amp;", "x<b>&lt;</b>y &"]
    pages = spark.createDataFrame([(k, f'<nav><ul><li><a href="/?a=1&amp;b">x</a></ul></nav><h1 class="t">{h}</h1><h1>z</h1>') for k, h in enumerate(heads)], "page_id bigint, html string")
    assert sorted(same(spark, tmp_path, "page_elements", pages=pages))[0] == (0, 1, 1, 10)
    assert "".join(elements(spelled("<p>&amp;lt;&amp</p>"), lambda e: e.tag == "p")[0].text) == "_lt;&amp"


def test_slugs_of_equal_hashes(spark, tmp_path):
    seen: dict[str, int] = {}
    for k in range(2, 1_000_000):
        other = seen.setdefault(hashlib.sha1(str(k).encode()).hexdigest()[:6], k)
        if other != k:
            break
    part = spark.createDataFrame([(1, "red pin"), (other, "red pin"), (k, "red pin")], "p_partkey bigint, p_name string")
    slugs = dict(same(spark, tmp_path, "unique_slug", part=part))
    assert slugs[1] == "red-pin" and slugs[k] == slugs[other] != "red-pin"


def physical(spark, folder, name):
    return plans.QUERIES[name](spark, str(folder))._jdf.queryExecution().sparkPlan().toString()


def test_facts_are_read_once_a_line(spark, tmp_path):
    rows = [(k, f"red pin {k % 3}", ["PROMO", "LARGE", "SMALL"][k % 3], k % 4 * 7, 900.0 + k, "Brand#1") for k in range(40)]
    part = spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double, p_brand string")
    same(spark, tmp_path, "fact_supports", part=part)
    condition = next(x for x in plans.QUERIES["fact_supports"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
    assert "RLIKE" not in condition and "regexp_replace" not in condition


def test_proposals_do_not_shuffle_pairs(spark, tmp_path):
    rows = [(k, "red pin", "PROMO" if k % 5 == 0 else "LARGE", k % 4, 900.0 + k, f"Brand#{k % 2}") for k in range(60)]
    part = spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double, p_brand string")
    same(spark, tmp_path, "link_proposals", part=part)
    assert "collect_list" not in physical(spark, tmp_path, "link_proposals")


def test_duplicates_are_not_shuffled(spark, tmp_path):
    rows = [(k, "HOUSEHOLD" if k % 2 else "BUILDING", k % 3) for k in range(0, 6000, 37)] + [(k + 401 * 307, "HOUSEHOLD", k % 3) for k in range(1, 40)]
    customer = spark.createDataFrame(rows, "c_custkey bigint, c_mktsegment string, c_nationkey int")
    assert same(spark, tmp_path, "catalogue_duplicates", customer=customer)
    assert "keys=[a_id" not in physical(spark, tmp_path, "catalogue_duplicates")


def lines_of(plan):
    return plan.optimizedPlan().toString().splitlines()


def test_distances_are_measured_where_a_grade_may_come_of_them(spark, tmp_path):
    rows = [(k, "HOUSEHOLD" if k % 2 else "BUILDING", k % 3) for k in range(0, 6000, 37)] + [(k + 401 * 307, "HOUSEHOLD", k % 3) for k in range(1, 40)]
    customer = spark.createDataFrame(rows, "c_custkey bigint, c_mktsegment string, c_nationkey int")
    assert same(spark, tmp_path, "catalogue_duplicates", customer=customer)
    found = [x for x in lines_of(plans.QUERIES["catalogue_duplicates"](spark, str(tmp_path))._jdf.queryExecution()) if "Join Inner" in x]
    first = [x for x in found if "abs((a_lat" in x]
    assert len(first) == 2 and all("ASIN" not in x.split("abs((a_lat")[0] for x in first)


def test_lines_and_pages_of_one_class_meet_as_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "LISTED", 3)
    rows = [(k, "red pin", "PROMO" if k % 5 == 0 else "LARGE", k % 4, 901.0, f"Brand#{k % 2}") for k in range(60)]
    part = spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double, p_brand string")
    for name, last in (("fact_supports", "explode(claims"), ("link_proposals", "explode(onto")):
        same(spark, tmp_path / name, name, part=part)
        plan = lines_of(plans.QUERIES[name](spark, str(tmp_path / name))._jdf.queryExecution())
        assert any(last in x for x in plan) and not any("_parts" in x or "array_intersect" in x for x in plan[: next(k for k, x in enumerate(plan) if last in x)])


def test_few_places_are_the_side_sent(spark, tmp_path):
    rows = [(k, f"red pin{k % 7}", "PROMO" if k % 5 == 0 else "ECONOMY", 45 + k % 4, f"Brand#{k % 3}") for k in range(60)]
    part = spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_type string, p_size int, p_brand string")
    assert same(spark, tmp_path, "image_places", part=part)
    plan = physical(spark, tmp_path, "image_places")
    assert "BuildRight" in plan and "BuildLeft" not in plan
