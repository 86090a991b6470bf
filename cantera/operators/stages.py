"""The stages of a catalogue entry: a status that only moves on, times, errors, and what may run.

An event is (key, seq, kind, status, force, at, message): a transition to a status, or an
error in the stage that leads to one. A status only rises unless forced; each status keeps
the time it was first reached; a forced transition sets its time again and clears all later
ones; a transition clears the last error, and one after an error always counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statuses in order, and for each stage what it needs and what it makes.
ORDER = ("discovered", "enriched", "generated", "validated", "imported", "reviewed", "published")
STAGES = {"enrichment": ("discovered", "enriched"), "generation": ("enriched", "generated"), "qa": ("generated", "validated")}
EVENT = "seq bigint, kind string, status string, force boolean, at timestamp, message string"
STATE = f"status string, {', '.join(f'{s}_at timestamp' for s in ORDER)}, error_stage string, error_message string, error_at timestamp, seq bigint"
_STATE = f"struct<{', '.join(x.replace(' ', ': ', 1) for x in STATE.split(', '))}>"
TIMES = [f"{s}_at" for s in ORDER]


def advanced(state: dict, event: dict) -> dict:
    """The state after an event, as plain values; events that don't come after the last one change nothing."""
    seq = event["seq"]
    if seq is None or (state["seq"] is not None and seq <= state["seq"]):
        return state
    out = dict(state, seq=seq)
    if event["kind"] == "error":
        return out | {"status": "error", "error_stage": event["status"], "error_message": event["message"], "error_at": event["at"]}
    if event["status"] not in ORDER:
        return out
    to, force = ORDER.index(event["status"]), bool(event["force"])
    now = ORDER.index(state["status"]) if state["status"] in ORDER else -1
    if force or now < to:
        out["status"] = event["status"]
    if force or state[TIMES[to]] is None:
        out[TIMES[to]] = event["at"]
    if force:
        out |= dict.fromkeys(TIMES[to + 1 :])
    return out | {"error_stage": None, "error_message": None, "error_at": None}


def empty() -> dict:
    return dict.fromkeys(x.split()[0] for x in STATE.split(", "))


def replayed(events: DataFrame, key: str) -> DataFrame:
    """(key, the columns of ``STATE``): each entry's state after all its events, by seq; of events that repeat a seq one counts, the least by its other columns.

    An entry's events are its life, tens of rows; they are folded as one array.
    """
    names = [x.split()[0] for x in EVENT.split(", ")]
    lists = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_events"))
    order = F.array(*[F.lit(s) for s in ORDER])
    start = F.struct(*[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in STATE.split(", ")]).cast(_STATE)

    def step(s: Column, e: Column) -> Column:
        to = F.array_position(order, e["status"])
        now = F.coalesce(F.array_position(order, s["status"]), F.lit(0))
        force = F.coalesce(e["force"], F.lit(False))
        error = F.struct(F.lit("error").alias("status"), *[s[t].alias(t) for t in TIMES], e["status"].alias("error_stage"), e["message"].alias("error_message"), e["at"].alias("error_at"), e["seq"].alias("seq"))
        times = [F.when(to == k + 1, F.when(force | s[t].isNull(), e["at"]).otherwise(s[t])).when(force & (to <= k), F.lit(None).cast("timestamp")).otherwise(s[t]).alias(t) for k, t in enumerate(TIMES)]
        moved = F.struct(F.when(force | (now < to), e["status"]).otherwise(s["status"]).alias("status"), *times, F.lit(None).cast("string").alias("error_stage"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("timestamp").alias("error_at"), e["seq"].alias("seq"))
        seen = F.struct(*[s[x.split()[0]].alias(x.split()[0]) for x in STATE.split(", ")[:-1]], e["seq"].alias("seq"))
        late = e["seq"].isNull() | F.coalesce(e["seq"] <= s["seq"], F.lit(False))
        return F.when(late, s).when(e["kind"] == "error", error.cast(_STATE)).when(F.coalesce(to, F.lit(0)) > 0, moved.cast(_STATE)).otherwise(seen.cast(_STATE))

    return lists.select(key, F.aggregate("_events", start, step).alias("_s")).select(key, "_s.*")


def can_run(stage: str, force: bool = False) -> Column:
    """Whether a stage may run on a state: what it needs is there and what it makes isn't; after an error, the stage that failed."""
    if force or stage not in STAGES:
        return F.lit(True) if force else F.when(F.col("status") == "error", F.coalesce(F.col("error_stage") == stage, F.lit(False))).otherwise(True)
    needs, makes = STAGES[stage]
    return F.when(F.col("status") == "error", F.coalesce(F.col("error_stage") == stage, F.lit(False))).otherwise(F.col(f"{needs}_at").isNotNull() & F.col(f"{makes}_at").isNull())
