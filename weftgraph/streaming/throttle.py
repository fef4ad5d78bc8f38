"""The throttle as a stateful stream: accepted times per client are the state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftgraph.operators.throttle import COLUMNS, admit_hit


def decide_stream(hits: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Streaming ``hits(bucket, client, hit_id, ts_us)`` → decisions.

    State is at most ``limit`` times per client and is dropped when a client
    stays away for a whole window. Run it as a continuous query with a
    processing-time trigger: the clock that drops idle clients keeps an
    ``availableNow`` run from ending.
    """
    window_us = window_seconds * 1_000_000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["ts_us", "hit_id"])
        decisions = [admit_hit(accepted, t, limit, window_us) for t in rows.ts_us]
        rows["accepted"] = [d[0] for d in decisions]
        rows["retry_after"] = pd.array([d[1] for d in decisions], dtype="Int64")
        state.update((list(accepted),))
        state.setTimeoutDuration(window_seconds * 1000)
        yield rows[["bucket", "client", "hit_id", "ts_us", "accepted", "retry_after"]]

    return hits.groupBy("bucket", "client").applyInPandasWithState(
        step, COLUMNS, "accepted array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
