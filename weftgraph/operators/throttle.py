"""Sliding-window throttle over a table of hits."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import cut

WHO = ["bucket", "client"]
COLUMNS = "bucket string, client string, hit_id bigint, ts_us bigint, accepted boolean, retry_after bigint"

# Fixed values: (hits, window seconds) per bucket of the service.
ANALYZE_RATE, NARRATE_RATE, GLOBAL_RATE = (12, 600), (6, 3600), (600, 60)


def admit_hit(accepted: deque, now: int, limit: int, window_us: int) -> tuple[bool, int | None]:
    """One decision; ``accepted`` holds the accepted times still inside the window."""
    while accepted and now - accepted[0] > window_us:
        accepted.popleft()
    if len(accepted) >= limit:
        return False, max(1, math.ceil((window_us - (now - accepted[0])) / 1_000_000))
    accepted.append(now)
    return True, None


def admit_hits(accepted: deque, times: np.ndarray, limit: int, window_us: int) -> tuple[np.ndarray, np.ndarray]:
    """``admit_hit`` for sorted times: accepted, and the wait of the others (0 for accepted ones).

    All hits up to the end of the oldest accepted one's window are refused at once, so there is one step for each accepted hit.
    """
    ok, wait = np.zeros(len(times), bool), np.zeros(len(times), np.int64)
    i = 0
    while i < len(times):
        ok[i], _ = admit_hit(accepted, int(times[i]), limit, window_us)
        if ok[i]:
            i += 1
            continue
        end = accepted[0] + window_us
        stop = int(np.searchsorted(times, end, side="right"))
        wait[i:stop] = np.maximum(1, -((times[i:stop] - end) // 1_000_000))
        i = stop
    return ok, wait


def _walk_bursts(limit: int, window_us: int):
    """Streams sorted bursts; memory is one batch and at most ``limit`` times."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, deque()
        for batch in batches:
            keys = [batch[c].to_numpy() for c in (*WHO, "run")]
            turns = np.flatnonzero(np.logical_or.reduce([(k[1:] != k[:-1]).astype(bool) for k in keys])) + 1
            times = batch.ts_us.to_numpy()
            ok, wait = np.zeros(len(batch), bool), np.zeros(len(batch), np.int64)
            for a, b in zip([0, *turns], [*turns, len(batch)], strict=True):
                if a == b:
                    continue
                if (now := tuple(k[a] for k in keys)) != current:
                    current, accepted = now, deque()
                # a sure hit always finds room, so the same rule serves for both
                ok[a:b], wait[a:b] = admit_hits(accepted, times[a:b], limit, window_us)
            out = batch[["bucket", "client", "hit_id", "ts_us"]].copy()
            out["accepted"] = ok
            out["retry_after"] = pd.array(wait, dtype="Int64")
            out.loc[ok, "retry_after"] = pd.NA
            yield out[(~batch.sure).values]

    return walk


def decide(hits: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """hits(bucket, client, hit_id, ts_us) → the same with accepted and retry_after.

    A hit with fewer than ``limit`` hits of any kind in its window is accepted
    whatever happened before; those are found by windows over one stretch of
    time each, so a client with very many hits is spread over its time range.
    Only overload bursts depend on earlier decisions. A burst, with the sure
    hits just before it, does not depend on anything else, so bursts are walked
    independently of each other.
    """
    w = window_seconds * 1_000_000
    span = F.floor(F.col("ts_us") / w)
    # Each hit is its own in one stretch and context for the next one.
    copies = hits.withColumn("c", F.explode(F.array(
        F.struct(span.alias("span"), F.lit(True).alias("own")),
        F.struct((span + 1).alias("span"), F.lit(False).alias("own")),
    ))).select(*WHO, "hit_id", "ts_us", "c.*")
    # The window of a hit is full if the hit ``limit`` places before it, or before the last one of its time, lies inside. A lag
    # looks at one row for each hit, where a count over the window would look at all that is in it.
    by_ts = Window.partitionBy(*WHO, "span").orderBy("ts_us")
    far = F.max("back").over(Window.partitionBy(*WHO, "span", "ts_us"))
    marked = cut(
        copies.withColumn("back", F.lag(F.coalesce("ts_us", F.lit(0)), limit).over(by_ts)).withColumn("far", far).where("own")
        .select(*WHO, "hit_id", "ts_us", "span", F.coalesce(F.col("far").isNull() | (F.col("far") < F.col("ts_us") - w), F.lit(False)).alias("sure"))
    )
    # Bursts from the few per-stretch extremes, not from the hits.
    spans = marked.where(~F.col("sure")).groupBy(*WHO, "span").agg(
        F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")
    )
    by_time = Window.partitionBy(*WHO).orderBy("span")
    gap = F.col("lo") - F.lag("hi").over(by_time) > w
    runs = spans.withColumn("fresh", F.coalesce(gap, F.lit(True)).cast("int")).withColumn(
        "run", F.sum("fresh").over(by_time)
    )
    limits = runs.groupBy(*WHO, "run").agg(
        F.min("lo").alias("start"), F.max("hi").alias("end"), F.min("span").alias("first"),
        F.max("span").alias("last"),
    )
    where = limits.select(
        *WHO, "run", "start", "end", F.explode(F.sequence(F.col("first") - 1, F.col("last"))).alias("span")
    )
    bursts = marked.join(where, [*WHO, "span"]).where(
        F.col("ts_us").between(F.col("start") - w, F.col("end"))
    ).select(*WHO, "run", "hit_id", "ts_us", "sure")
    walked = (
        bursts.repartition(*WHO, "run").sortWithinPartitions(*WHO, "run", "ts_us", "hit_id")
        .mapInPandas(_walk_bursts(limit, w), COLUMNS)
    )
    sure = marked.where("sure").select(
        *WHO, "hit_id", "ts_us", F.lit(True).alias("accepted"), F.lit(None).cast("bigint").alias("retry_after")
    )
    return sure.unionByName(walked)
