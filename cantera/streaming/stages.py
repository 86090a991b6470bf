"""The stage machine on a stream: one keyed state an entry, with a timer for entries that stand still."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from cantera.operators.stages import EVENT, ORDER, STATE, advanced, empty

NAMES = [x.split()[0] for x in STATE.split(", ")]
FIELDS = [x.split()[0] for x in EVENT.split(", ")]


def _plain(value):
    """A value of a frame as Python has it, null for any mark of a missing one."""
    if value is None or pd.isna(value):
        return None
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if hasattr(value, "item") else value


def stage_stream(events: DataFrame, key: str, patience: int = 0, late: str = "1 day") -> DataFrame:
    """(key, the columns of ``STATE``, stalled): updates of entries whose state changes or that stand still.

    events: a stream of (key, the columns of ``EVENT``). The events of a key are applied in
    the order of seq, once a batch; those of a seq that was applied before, in this batch or
    an earlier one, change nothing, so a source that sends rows again after a restart does
    no harm. If ``patience`` milliseconds of event time pass without an event for an entry
    that isn't published, its state is given again with ``stalled``; events later than
    ``late`` are dropped then.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = dict(zip(NAMES, map(_plain, held.get), strict=True)) if held.exists else empty()
        stalled = held.hasTimedOut
        if not stalled:
            rows = [{c: _plain(v) for c, v in r.items()} for f in frames for r in f[FIELDS].to_dict("records")]
            rows.sort(key=lambda e: [(e[c] is not None, e[c]) if e[c] is not None else (False,) for c in FIELDS])
            before = state["seq"]
            for e in rows:
                state = advanced(state, e)
            if state["seq"] == before:
                return
            held.update(tuple(state[c] for c in NAMES))
            last = max((e["at"] for e in rows if e["at"] is not None), default=None)
            if patience and last is not None and state["status"] != ORDER[-1]:
                due = int(pd.Timestamp(last, tz="UTC").timestamp() * 1000) + patience
                held.setTimeoutTimestamp(max(due, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*keys, *[state[c] for c in NAMES], stalled)], columns=[key, *NAMES, "stalled"]).astype(object)

    rows = events.select(key, *FIELDS)
    rows = rows.withWatermark("at", late) if patience else rows
    schema = f"{key} {events.schema[key].dataType.simpleString()}, {STATE}, stalled boolean"
    return rows.groupBy(key).applyInPandasWithState(step, schema, STATE, "append", "EventTimeTimeout" if patience else "NoTimeout")
