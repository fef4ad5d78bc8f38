"""Snapshot cache, retention and visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values the results depend on.
CACHE_TTL_SECONDS = 600
MAX_PROJECTS = 5000
SESSION_MAX_AGE_SECONDS = 60 * 60 * 24 * 30


def cache_key(owner: Column, repo: Column, ref: Column, viewer: Column) -> Column:
    """owner/repo@ref, scoped to the viewer when signed in."""
    base = F.concat(owner, F.lit("/"), repo, F.lit("@"), F.coalesce(ref, F.lit("default")))
    return F.when(viewer.isNull(), base).otherwise(F.concat(viewer, F.lit(":"), base))


def _expired(at: Column, now: Column, seconds: int) -> Column:
    return at < now - F.expr(f"INTERVAL {seconds} SECONDS")


def cache_lookup(cache: DataFrame, snapshots: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """(cache_key, outcome, snapshot_id): hit, expired, dangling or miss; an id only for a hit."""
    known = snapshots.select("snapshot_id", F.lit(True).alias("_known")).distinct()
    found = keys.select("cache_key").join(
        cache.select("cache_key", "snapshot_id", "cached_at"), "cache_key", "left"
    ).join(known, "snapshot_id", "left")
    outcome = (
        F.when(F.col("cached_at").isNull(), "miss")
        .when(_expired(F.col("cached_at"), now, CACHE_TTL_SECONDS), "expired")
        .when(F.col("_known").isNull(), "dangling").otherwise("hit")
    )
    return found.withColumn("outcome", outcome).select(
        "cache_key", "outcome", F.when(F.col("outcome") == "hit", F.col("snapshot_id")).alias("snapshot_id")
    )


def cache_upsert(cache: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Unexpired old rows plus ``new``; the latest row of a key wins, new before old.

    ``new`` needs a ``seq`` column (write order). The winner is an aggregate,
    so a key written very often is reduced before the shuffle.
    """
    cols = ["cache_key", "snapshot_id", "cached_at"]
    old = cache.where(~_expired(F.col("cached_at"), now, CACHE_TTL_SECONDS)).select(
        *cols, F.lit(0).alias("gen"), F.lit(0).cast("bigint").alias("seq")
    )
    add = new.select(*cols, F.lit(1).alias("gen"), F.col("seq").cast("bigint").alias("seq"))
    return old.unionByName(add).groupBy("cache_key").agg(
        F.max(F.struct("gen", "seq", "cached_at", "snapshot_id")).alias("w")
    ).select("cache_key", "w.snapshot_id", "w.cached_at")


def retained(snapshots: DataFrame, keep: int = MAX_PROJECTS) -> DataFrame:
    """The newest ``keep`` snapshots (ties: larger id first)."""
    return snapshots.orderBy(F.desc("created_at"), F.desc("snapshot_id")).limit(keep)


def retention(snapshots: DataFrame, dependents: DataFrame, keep: int = MAX_PROJECTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept snapshots, dropped snapshots, dependents of what was not dropped)."""
    kept = retained(snapshots, keep)
    ids = kept.select("snapshot_id")
    dropped = snapshots.join(ids, "snapshot_id", "left_anti")
    left = dependents.join(dropped.select("snapshot_id"), "snapshot_id", "left_anti")
    return kept, dropped, left


def unexpired_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(~_expired(F.col("created_at"), now, SESSION_MAX_AGE_SECONDS))


def visible(snapshots: DataFrame, viewer: Column) -> DataFrame:
    """Public snapshots, and private ones of the viewer; NULL viewer sees only public ones."""
    return snapshots.where(~F.col("is_private") | F.coalesce(F.col("owner") == viewer, F.lit(False)))
