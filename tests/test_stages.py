"""The stage machine: replayed, on a stream, over restarts, and with its timer."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cantera.operators import stages
from cantera.streaming.stages import stage_stream

NAMES = [x.split()[0] for x in stages.STATE.split(", ")]
SCHEMA = f"entry string, {stages.EVENT}"
DAY = datetime(2026, 1, 1)


def events(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for seq in range(n):
        error = rnd.random() < 0.15
        status = rnd.choice(["enrichment", "qa"]) if error else rnd.choice([*stages.ORDER, "unknown"])
        out.append((rnd.choice("abc"), seq, "error" if error else "transition", status, rnd.choice([True, False, False, None]), DAY + timedelta(hours=seq), rnd.choice(["m", None])))
    return out


def by_hand(rows):
    state = {}
    for key, *event in sorted(rows, key=lambda r: (r[1] is not None, r[1])):
        e = dict(zip([x.split()[0] for x in stages.EVENT.split(", ")], event, strict=True))
        state[key] = stages.advanced(state.get(key, stages.empty()), e)
    return {k: tuple(s[c] for c in NAMES) for k, s in state.items()}


def test_transitions():
    t = lambda seq, status, force=False: {"seq": seq, "kind": "transition", "status": status, "force": force, "at": DAY + timedelta(days=seq), "message": None}
    s = stages.advanced(stages.advanced(stages.empty(), t(1, "discovered")), t(2, "generated"))
    assert (s["status"], s["enriched_at"], s["generated_at"]) == ("generated", None, DAY + timedelta(days=2))
    back = stages.advanced(s, t(3, "enriched"))
    assert (back["status"], back["enriched_at"], back["generated_at"]) == ("generated", DAY + timedelta(days=3), DAY + timedelta(days=2))
    forced = stages.advanced(s, t(3, "discovered", True))
    assert (forced["status"], forced["discovered_at"], forced["generated_at"]) == ("discovered", DAY + timedelta(days=3), None)
    failed = stages.advanced(s, {"seq": 3, "kind": "error", "status": "qa", "force": None, "at": DAY, "message": "no"})
    assert (failed["status"], failed["error_stage"], failed["generated_at"]) == ("error", "qa", DAY + timedelta(days=2))
    again = stages.advanced(failed, t(4, "discovered"))
    assert (again["status"], again["error_stage"], again["discovered_at"]) == ("discovered", None, DAY + timedelta(days=1))
    assert stages.advanced(s, t(2, "published")) == s


def test_replay_matches_steps(spark):
    rows = [r for seed in range(5) for r in [(f"{seed}{k}", *rest) for k, *rest in events(seed)]] + [("n", None, "transition", "published", True, DAY, None), ("z", 1, None, None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:30], SCHEMA).repartition(4)
    got = {r.entry: tuple(r)[1:] for r in stages.replayed(df, "entry").collect()}
    assert got == by_hand(rows)
    states = spark.createDataFrame([("error", "qa", None, None, None), ("generated", None, DAY, DAY, None), ("discovered", None, DAY, None, None)], "status string, error_stage string, discovered_at timestamp, generated_at timestamp, validated_at timestamp").withColumn("enriched_at", F.lit(None).cast("timestamp"))
    assert [tuple(r) for r in states.select(*[stages.can_run(s) for s in ("enrichment", "generation", "qa", "import")], stages.can_run("qa", True)).collect()] == [(False, False, True, False, True), (True, False, True, True, True), (True, False, False, True, True)]


def run(spark, tmp_path, patience=0):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stage_stream(stream, "entry", patience, "1 hour")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def land(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_stream_over_restarts(spark, tmp_path):
    rows = events(7)
    land(spark, tmp_path, rows[:30])
    run(spark, tmp_path)
    land(spark, tmp_path, rows[20:45])  # a source that sends a part again
    land(spark, tmp_path, rows[45:])
    out = run(spark, tmp_path)  # another run goes on from the checkpoint
    last = out.groupBy("entry").agg(F.max_by(F.struct(*NAMES), "seq").alias("s")).select("entry", "s.*")
    assert {r.entry: tuple(r)[1:] for r in last.collect()} == by_hand(rows)
    n = out.count()
    assert run(spark, tmp_path).count() == n  # nothing new, nothing changes
    assert out.where("stalled").count() == 0


def test_timer_of_entries_that_stand_still(spark, tmp_path):
    at = lambda h: DAY + timedelta(hours=h)
    land(spark, tmp_path, [("still", 1, "transition", "discovered", False, at(0), None), ("done", 1, "transition", "published", False, at(0), None), ("moves", 1, "transition", "discovered", False, at(0), None)])
    run(spark, tmp_path, 3_600_000 * 10)
    land(spark, tmp_path, [("moves", 2, "transition", "enriched", False, at(9), None)])
    run(spark, tmp_path, 3_600_000 * 10)
    land(spark, tmp_path, [("other", 1, "transition", "discovered", False, at(14), None)])
    out = run(spark, tmp_path, 3_600_000 * 10)
    assert [(r.entry, r.status) for r in out.where("stalled").collect()] == [("still", "discovered")]
