"""Work that one task did alone, or that was done more than once."""

import pytest
from pyspark.sql import functions as F

from cantera import plans
from cantera.operators import joins, pairs, validation

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_blocks_are_given_once_without_gathering_them(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 26.0), (2, 10.0), (4, None)], "id int, x double")
    blocks = [F.floor(F.col("x") / 50), F.floor((F.col("x") + 25) / 50)]
    found = pairs.blocked_pairs(df, "id", blocks, lambda a, b: F.abs(F.col(f"{a}x") - F.col(f"{b}x")) <= 25, ["x"])
    assert sorted((r.a_id, r.b_id) for r in found.collect()) == [(1, 2), (2, 3)]
    above = optimized(found).split("Join")[0]
    assert "Aggregate" not in above and "Distinct" not in above


def test_words_of_claims_and_facts_are_made_once(spark):
    assert optimized(plans.QUERIES["claim_support"](spark, SF)).count("regexp_replace(lower(") == 2


def test_sentences_are_cut_once(spark):
    assert optimized(plans.QUERIES["sentence_density"](spark, SF)).count("(?<=[.!?])") == 1


@pytest.mark.parametrize("name", ["identity_checks", "merged_lists", "page_images", "sentence_density"])
def test_rows_of_small_files_are_dealt_to_all_tasks(spark, name):
    assert "Repartition 4, true" in optimized(plans.QUERIES[name](spark, SF))


def test_points_of_one_cell_are_dealt_to_several_tasks(spark):
    rows = spark.createDataFrame([(k, 38.5, -0.1) for k in range(40)], "id int, lat double, lng double")
    found = joins.within_radius(rows, rows, 10.0)
    assert found.count() == 40 * 39 // 2
    assert sum(n > 0 for n in found.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) > 1


def test_few_rows_are_met_in_place_with_the_same_pairs(spark, monkeypatch):
    words = [(k, [f"w{(k * j) % 13}" for j in range(1, 6)]) for k in range(30)]
    sets = spark.createDataFrame(words, "key int, tokens array<string>").withColumn("tokens", F.array_distinct("tokens")).unionByName(spark.createDataFrame([(99, []), (98, None)], "key int, tokens array<string>"))
    counts = sets.select("key", F.explode("tokens").alias("token")).withColumn("n", F.col("key").cast("bigint") % 3 + 1)
    found = lambda: [sorted((r[0], r[1], round(r[2], 9)) for r in d.collect()) for d in (pairs.jaccard_pairs(sets, sets, 0.3), pairs.cosine_pairs(counts, counts, 0.4))]
    assert "array_intersect" not in optimized(pairs.jaccard_pairs(sets, sets, 0.3))
    here = found()
    monkeypatch.setattr(pairs, "MOST_KEYS", 0)
    assert here == found() and all(here)


def test_topics_are_matched_once(spark):
    assert "regexp_replace" not in optimized(plans.QUERIES["topic_selection"](spark, SF))


def test_blocks_meet_as_keys_without_their_tokens(spark):
    text = "terraza cubierta arroces caldosos paellas mixtas mariscos frescos"
    rows = [(1, "a", text), (1, "b", text + " diarios"), (2, "a", text), (2, "a", text + " hoy"), (3, "a", None), (3, "b", "corto")]
    found = validation.repeated_blocks(spark.createDataFrame(rows, "doc int, zone string, text string"))
    assert [r.doc for r in found.collect()] == [1]
    plan = optimized(found).splitlines()
    above = [plan[k - 1] for k, line in enumerate(plan) if "Generate explode" in line]
    assert above and not any("tokens" in line for line in above)
