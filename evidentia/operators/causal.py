"""Causal state: decisions on writes to a keyed state, in order of time. The same fold serves batches and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide_scalar(state: dict | None, write: dict) -> str:
    """ADMIT, IDEMPOTENT, CONFLICT or UNDERDETERMINED. No state admits; an equal value changes nothing; the same node or time conflicts; older is open."""
    if state is None:
        return "ADMIT"
    if state["value"] == write["value"]:
        return "IDEMPOTENT"
    if state["node"] == write["node"] or state["at"] == write["at"]:
        return "CONFLICT"
    return "UNDERDETERMINED" if write["at"] < state["at"] else "ADMIT"


def decide_location(state: dict | None, write: dict) -> str:
    """As for scalars, with explicit transitions, authoritative sensors and latent moves."""
    if state is None:
        return "ADMIT"
    if state["value"] == write["value"]:
        return "IDEMPOTENT"
    if write.get("event") == "transition":
        return "ADMIT"
    same = state["node"] == write["node"] or state["at"] == write["at"]
    if write.get("event") == "sensor":
        return "CONFLICT" if same else "ADMIT_LATENT"
    if same:
        return "REJECTED_IMPOSSIBLE"
    if write.get("latent"):
        return "UNDERDETERMINED" if write["at"] < state["at"] else "ADMIT_LATENT"
    return "CONFLICT"


def fold(writes: DataFrame, location: bool = False) -> DataFrame:
    """(key, seq, decision, value, version) of writes (key, seq, node, at, value, event, latent) in order of arrival. A key's writes are one group: its
    state depends on all before, so that a hot key is bounded by its own history."""
    rule = decide_location if location else decide_scalar

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, version, out = None, 0, []
        for w in rows.sort_values("seq").to_dict("records"):
            decision = rule(state, w)
            if decision.startswith("ADMIT"):
                state, version = w, version + 1
            out.append((w["key"], w["seq"], decision, state["value"] if state else None, version))
        return pd.DataFrame(out, columns=["key", "seq", "decision", "value", "version"])

    kind = writes.schema["value"].dataType.simpleString()
    return writes.groupBy("key").applyInPandas(run, f"key {writes.schema['key'].dataType.simpleString()}, seq long, decision string, value {kind}, version int")


def latest_state(writes: DataFrame) -> DataFrame:
    """(key, value, at) of the newest write per key, for writers whose order is the time itself. An aggregate: no fold."""
    return writes.groupBy("key").agg(F.max(F.struct("at", "seq", "value")).alias("m")).select("key", "m.value", "m.at")
