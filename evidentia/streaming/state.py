"""Stateful streams: versioned key-value state with causal decisions, and debounced scopes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.causal import decide_location, decide_scalar

DECISIONS = "key string, seq long, decision string, value string, version int"
_STATE = "node long, at long, value string, version int"


def causal(writes: DataFrame, location: bool = False) -> DataFrame:
    """Decisions on a stream of writes (key string, seq, node, at, value string, event, latent): an older write never overwrites a newer one."""
    rule = decide_location if location else decide_scalar

    def run(key, batches, state: GroupState):
        held = None
        version = 0
        if state.exists:
            node, at, value, version = state.get
            held = {"node": node, "at": at, "value": value}
        out = []
        for w in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
            decision = rule(held, w)
            if decision.startswith("ADMIT"):
                held, version = w, version + 1
            out.append((key[0], w["seq"], decision, held["value"] if held else None, version))
        if held:
            state.update((int(held["node"]), int(held["at"]), held["value"], version))
        yield pd.DataFrame(out, columns=["key", "seq", "decision", "value", "version"])

    return writes.groupBy("key").applyInPandasWithState(run, DECISIONS, _STATE, "append", GroupStateTimeout.NoTimeout)


def debounce(marks: DataFrame, quiet_ms: int = 30_000, most_ms: int = 300_000, late: str = "1 minute") -> DataFrame:
    """Scopes of a stream of marks (scope string, at long in ms) that are due: quiet for `quiet_ms`, or marked for `most_ms`.

    Event time drives it: a scope without a further mark comes out once the watermark, `late` behind the newest mark of any scope, has passed its time.
    Marks that are older than the watermark, or from before 1970, are dropped.
    """

    def run(key, batches, state: GroupState):
        first, last = state.get if state.exists else (None, None)
        due = []
        if state.hasTimedOut:
            due.append((key[0], first, last))
            state.remove()
        else:
            for at in sorted(int(x) for rows in batches for x in rows["at"]):
                if first is not None and (at - last >= quiet_ms or at - first >= most_ms):
                    due.append((key[0], first, last))
                    first = None
                first, last = (at if first is None else first), at if first is None else max(last, at)
            state.update((first, last))
            state.setTimeoutTimestamp(max(min(last + quiet_ms, first + most_ms), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(due, columns=["scope", "first", "last"])

    # a millisecond on, since the first watermark is 0 and what is not after the watermark is dropped
    timed = marks.withColumn("time", F.timestamp_millis(F.col("at") + 1)).withWatermark("time", late)
    return timed.groupBy("scope").applyInPandasWithState(run, "scope string, first long, last long", "first long, last long", "append", GroupStateTimeout.EventTimeTimeout)
