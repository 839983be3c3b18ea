"""Operation state machine: events of one operation, in order, move it through its states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: (state, event) -> state; anything else leaves the state, and ended operations take no event.
STEPS = {
    ("new", "submit"): "preflight_pending", ("preflight_pending", "claim"): "preflight_running", ("preflight_running", "receipt"): "preflight_ready",
    ("preflight_running", "reject"): "invalid", ("preflight_pending", "reject"): "invalid", ("preflight_ready", "confirm"): "execute_pending",
    ("execute_pending", "claim"): "executing", ("executing", "progress"): "executing", ("executing", "receipt"): "completed", ("executing", "partial"): "partial",
    ("executing", "drift"): "drifted", ("drifted", "retry"): "preflight_pending", ("partial", "retry"): "execute_pending", ("executing", "fail"): "failed",
    ("failed", "retry"): "execute_pending", ("preflight_ready", "cancel"): "cancelled", ("preflight_pending", "cancel"): "cancelled", ("completed", "rollback"): "rolled_back",
}
ENDED = ("invalid", "cancelled", "rolled_back")


def step(state: str, event: str) -> str:
    return STEPS.get((state, event), state)


def final_states(events: DataFrame, key: str, order: list[str], event: str) -> DataFrame:
    """(key, state, applied): the batch form of the machine."""
    kind = dict(events.dtypes)[key]

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        state, applied = "new", 0
        for e in g.sort_values(order, kind="stable")[event]:
            new = step(state, e)
            applied += (state, e) in STEPS
            state = new
        return pd.DataFrame({key: [g[key].iat[0]], "state": [state], "applied": [applied]})

    return events.select(key, event, *[c for c in order if c not in (key, event)]).groupBy(key).applyInPandas(fold, f"`{key}` {kind}, state string, applied bigint")


def live_states(events: DataFrame, key: str = "operation_id", idle: str = "10 minutes") -> DataFrame:
    """(key, state, applied) whenever an operation gets events; one that is idle beyond `idle` of event time is dropped.

    events: key, event, at (timestamp, with late ones up to 10 minutes), number (order within the operation).
    """
    minutes = int(idle.split()[0])
    kind = dict(events.dtypes)[key]

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, applied = state.get if state.exists else ("new", 0)
        for e in pd.concat(list(batches)).sort_values("number", kind="stable")["event"]:
            applied += (now, e) in STEPS
            now = step(now, e)
        state.update((now, applied))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + minutes * 60_000 + 1)
        yield pd.DataFrame({key: [k[0]], "state": [now], "applied": [applied]})

    marked = events.withWatermark("at", "10 minutes").select(key, "event", "number", "at")
    return marked.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, state string, applied bigint", "state string, applied bigint", "update", GroupStateTimeout.EventTimeTimeout)


def activity(events: DataFrame, t: str, key: str, gap: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """Activity sessions of a stream or a table: key, first, last, rows."""
    held = events.withColumn("_t", F.col(t).cast("timestamp"))
    held = held.withWatermark("_t", late) if events.isStreaming else held
    w = F.session_window("_t", gap)
    return held.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.min("_t").alias("first"), F.max("_t").alias("last")).select(key, "first", "last", "rows")
