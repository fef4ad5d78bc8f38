"""Elementary cycles, shortest first, and what is derived from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from weftgraph.operators import packs
from weftgraph.operators.components import strong_components
from weftgraph.session import cut, cut_measure, scratch_path, spread

KEY = "project_id"

# Fixed values the results depend on.
MAX_CYCLES = 200
AHEAD = 4  # lengths looked ahead at least
ROUND_ROWS = 100_000  # paths made by a round, up to which the next looks further ahead


def _inner_edges(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Edges inside a component, with its ``component_id``; only those can lie on a cycle."""
    a = scc.select(KEY, F.col("node_id").alias("source"), "component_id")
    b = scc.select(KEY, F.col("node_id").alias("target"), "component_id")
    return spread(spread(edges.select(KEY, "source", "target"), a, [KEY, "source"]), b, [KEY, "target", "component_id"]).select(
        KEY, "source", "target", "component_id")


def all_cycles(edges: DataFrame, scc: DataFrame, limit: int | None = MAX_CYCLES, whole: int = 0) -> DataFrame:
    """(project_id, len, path): every cycle, or with a ``limit`` enough of the shortest to list that many and to tell that there are more.

    A cycle is found once, from its smallest node, so it is already in canonical rotation. Components of up to ``whole`` edges are searched in
    one task each, if their paths fit there; all others together in rounds.
    """
    inner = cut(_inner_edges(edges, scc))
    if not whole:
        return _best_first(inner, limit)
    part = [KEY, "component_id"]
    n = F.col("n")
    sizes, seen = cut_measure(inner.groupBy(*part).agg(F.count(F.lit(1)).alias("n")), small=F.sum(F.when(n <= whole, n)), large=F.count_if(n > whole))
    large = sizes.where(n > whole).select(*part)
    small = spread(inner, large, part, "left_anti") if seen["large"] else inner
    rows = packs.in_tasks(small.withColumnRenamed("component_id", "part"), seen["small"] or 0, _FOUND, lambda pack: _found(pack, limit, HELD))
    found, told = cut_measure(rows, wide=F.count_if(F.col("path").isNull()))
    if told["wide"]:
        large = large.unionByName(found.where("path IS NULL").select(KEY, F.col("part").alias("component_id")))
    found = found.where("path IS NOT NULL").select(KEY, "len", "path")
    if seen["large"] or told["wide"]:
        found = found.unionByName(_best_first(cut(spread(inner, large, part, "left_semi")), limit))
    return found


_FOUND = f"{KEY} string, part string, len int, path array<string>"
HELD = 8_000_000  # numbers of paths, ways back and cycles that a task holds
STEP_NUMBERS = 1_000_000  # numbers of the paths that are extended at once, about


class _TooWide(Exception):
    """The paths of a part are more than a task holds."""


def _found(pack: packs.Pack, limit: int | None, most: int) -> Iterator[pa.RecordBatch]:
    """Cycles of a pack; a part that is too wide has one row without a path and no other."""
    try:
        found, wide = _shortest(pack.n, pack.part, pack.source, pack.target, limit, most), []
    except _TooWide:
        found, wide = [], []
        of = pack.part[pack.source]
        for part in np.unique(of):
            at = of == part
            try:
                found += _shortest(pack.n, pack.part, pack.source[at], pack.target[at], limit, most)
            except _TooWide:
                wide.append(pack.source[at][0])
    text = pa.list_(pa.string())
    for paths in found:
        k, size = paths.shape
        names = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * size), pack.names.take(pa.array(paths.ravel())))
        at = pa.array(paths[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pack.projects.take(at), pack.parts.take(at), pa.array(np.full(k, size, np.int32)), names.cast(text)], names=[KEY, "part", "len", "path"])
    if wide:
        at = pa.array(np.array(wide))
        yield pa.RecordBatch.from_arrays(
            [pack.projects.take(at), pack.parts.take(at), pa.nulls(len(wide), pa.int32()), pa.nulls(len(wide), text)], names=[KEY, "part", "len", "path"])


class _Back:
    """Steps from a node to a start through nodes above it, as far as they have been asked for."""

    def __init__(self, n: int, into: packs.Steps, starts: np.ndarray):
        self.n, self.into, self.keys, self.reached = n, into, starts * n + starts, 0
        self.steps, self.edge = np.zeros(len(starts), np.int32), self.keys
        self.going = np.zeros(n, bool)  # starts that more nodes may lead to
        self.going[starts] = True

    def extend(self, wanted: np.ndarray) -> None:
        """By one step, for the starts that are ``wanted``."""
        edge = self.edge[wanted[self.edge // self.n]]
        came, prev = self.into.ahead(edge % self.n)
        start = edge[came] // self.n
        new = np.unique((start * self.n + prev)[prev > start])
        self.edge = new[self.of(new) < 0]
        self.reached += 1
        keys = np.concatenate((self.keys, self.edge))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.steps = np.concatenate((self.steps, np.full(len(self.edge), self.reached, np.int32)))[order]
        self.going[:] = False
        self.going[self.edge // self.n] = True

    def of(self, key: np.ndarray) -> np.ndarray:
        """Steps of ``start * n + node``, -1 where they are not known."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.steps[at], -1)

    def bound(self, start: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
        """The least length of a cycle that begins with a path of ``size`` nodes, -1 if there is none."""
        steps = self.of(start * self.n + last)
        return np.where(steps >= 0, size - 1 + steps, np.where(self.going[start], size + self.reached, -1))


def _shortest(n: int, part: np.ndarray, source: np.ndarray, target: np.ndarray, limit: int | None, most: int) -> list[np.ndarray]:
    """Cycles as rows of node numbers, one array a length: of each part all, or its ``limit`` + 1 shortest, ties by path.

    Paths are extended in the order of the least length that they can close at, as in ``_best_first``; a part is through when it has more than
    ``limit`` cycles that are no longer than what is due.
    """
    if not len(source):
        return []
    steps, starts = packs.Steps(n, source, target), np.unique(source)
    back = _Back(n, packs.Steps(n, target, source), starts)
    known, done = np.zeros(part.max() + 1, np.int64), np.zeros(part.max() + 1, bool)
    pool: dict[int, dict[int, list[np.ndarray]]] = {1: {1: [starts[:, None]]}}
    found: list[np.ndarray] = []
    listed = 0

    def put(rows: np.ndarray, due: np.ndarray, into: Callable[[int], dict[int, list[np.ndarray]]]) -> None:
        for length in np.unique(due[due > 0]):
            into(int(length)).setdefault(rows.shape[1], []).append(rows[due == length])

    later = lambda length: pool.setdefault(length, {})
    while pool:
        due = min(pool)
        while back.reached < (due + 1) // 2 and back.going.any():
            back.extend(~done[part])
        layers, closed = pool.pop(due), []
        now_or_later = lambda length: layers if length == due else later(length)
        while layers:
            size = min(layers)
            rows = np.concatenate(layers.pop(size))
            rows = rows[~done[part[rows[:, 0]]]]
            if size > 1:  # more ways back may be known by now
                bound = back.bound(rows[:, 0], rows[:, -1], size)
                put(rows[bound > due], bound[bound > due], later)
                rows = rows[bound == due]
            many = steps.first[rows[:, -1] + 1] - steps.first[rows[:, -1]]
            bunch = np.cumsum(many) * size // STEP_NUMBERS
            for some in np.split(rows, np.flatnonzero(np.diff(bunch)) + 1):
                came, after = steps.ahead(some[:, -1])
                start = some[came, 0]
                closes = after == start
                if closes.any():
                    closed.append(some[came[closes]])
                onward = after > start
                onward[onward] = ~(some[came[onward]] == after[onward, None]).any(axis=1)
                longer = np.concatenate((some[came[onward]], after[onward, None]), axis=1)
                put(longer, back.bound(start[onward], after[onward], size + 1), now_or_later)
            held = sum(r.size for at in (layers, *pool.values()) for more in at.values() for r in more)
            if held + 2 * len(back.keys) + sum(r.size for r in closed) + listed > most:
                raise _TooWide
        if not closed:
            continue
        rows = np.concatenate(closed)
        rows = rows[np.lexsort(rows.T[::-1])]  # by part and path
        of = part[rows[:, 0]]
        if limit is not None:
            nth = np.arange(len(rows)) - np.searchsorted(of, of)
            rows = rows[nth + known[of] <= limit]
        known += np.bincount(of, minlength=len(known))
        found.append(rows)
        listed += rows.size
        if limit is not None and ((known > limit) & ~done).any():
            done = known > limit
            for length in [*pool]:
                layers = pool.pop(length)
                kept = {size: [r[~done[part[r[:, 0]]]] for r in more] for size, more in layers.items()}
                kept = {size: [r for r in more if len(r)] for size, more in kept.items()}
                if kept := {size: more for size, more in kept.items() if more}:
                    pool[length] = kept
    return found


class _WayBack:
    """(start, last, back): steps from ``last`` to ``start`` through nodes above it, as far as they have been asked for.

    All distances are appended to one table. ``reached`` is the distance up to which all rows are there; ``ended`` says that there are none
    beyond. ``made`` is the number of rows of the last distance. Projects that ``extend`` is told are done are followed no further.
    """

    _ROW = "p bigint, start bigint, last bigint, back int"

    def __init__(self, links: DataFrame):
        self.spark, self.path = links.sparkSession, scratch_path(links.sparkSession, "way-back")
        self.into = links.select(F.col("target").alias("last"), F.col("source").alias("prev"))
        starts = links.select("p", F.col("source").alias("start")).distinct()
        starts.select("p", "start", F.col("start").alias("last"), F.lit(0).alias("back")).write.parquet(self.path)
        self.reached, self.ended, self.made = 0, False, 0

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self._ROW).parquet(self.path)

    def extend(self, distance: int, done: DataFrame) -> None:
        """Up to ``distance``, but for the projects ``done(p)``."""
        while self.reached < distance and not self.ended:
            edge = self.rows().where(F.col("back") == self.reached).join(done.select("p"), "p", "left_anti")
            further = (
                spread(edge, self.into, "last").where(F.col("prev") > F.col("start"))
                .select("p", "start", F.col("prev").alias("last")).distinct()
            )
            further = spread(further, self.rows().select("start", "last"), ["start", "last"], "left_anti")
            self.reached += 1
            count = Observation()
            further.withColumn("back", F.lit(self.reached)).observe(count, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(self.path)
            self.made = count.get["n"]
            self.ended = not self.made


def _best_first(inner: DataFrame, limit: int | None) -> DataFrame:
    """Always extend the paths that can close soonest.

    ``bound`` = length so far + steps back to the start, so a path is touched only when its shortest possible cycle is due. Where the steps
    back are not known yet they are more than the known distance, which bounds them too. Distances are grown to half of the lengths that are
    due, so that paths and ways back meet in the middle, and only in projects that still look for cycles. As long as a round
    makes few rows, the next one looks twice as far ahead.

    Files are numbered in their order. Every round appends its rows to one table; a row is extended in the first later round whose ``upto`` is not below its bound.
    """
    spark = inner.sparkSession
    ends = inner.select(KEY, F.explode(F.array("source", "target")).alias("node_id")).distinct()
    names = cut(ends.repartitionByRange(KEY, "node_id").sortWithinPartitions(KEY, "node_id").withColumn("id", F.monotonically_increasing_id()))
    projects = names.groupBy(KEY).agg(F.min("id").alias("p"))
    links = inner.select(KEY, "source", "target").join(projects, KEY)
    for end in ("source", "target"):
        links = spread(links, names.select(KEY, F.col("node_id").alias(end), F.col("id").alias(f"_{end}")), [KEY, end])
    links = cut(links.select("p", F.col("_source").alias("source"), F.col("_target").alias("target")))
    row = "p bigint, start bigint, path array<bigint>, last bigint, bound int, closed boolean, made int"
    path, shut = scratch_path(spark, "paths"), scratch_path(spark, "closed")
    back = _WayBack(links)
    links.select("p", F.col("source").alias("start")).distinct().select(
        "p", "start", F.array("start").alias("path"), F.col("start").alias("last"), F.lit(2).alias("bound"), F.lit(False).alias("closed"),
        F.lit(0).alias("made")).write.parquet(path)
    cycle = "p bigint, len int, path array<bigint>"
    spark.createDataFrame([], cycle).write.parquet(shut)
    found = lambda: spark.read.schema(cycle).parquet(shut)
    done = spark.createDataFrame([], "p bigint, enough int")
    table = lambda: spark.read.schema(row).parquet(path).where("NOT closed").join(done, "p", "left").where(
        F.col("enough").isNull() | (F.col("bound") <= F.col("enough"))).drop("enough")
    made, due, ahead, before = 0, 2, AHEAD, 0
    while due is not None:
        upto = max(before, due + AHEAD)
        back.extend((upto + 1) // 2, done)
        while back.reached < (due + ahead + 1) // 2 and back.made <= ROUND_ROWS and not back.ended:
            back.extend(back.reached + 1, done)
        upto = max(upto, due + ahead if back.ended else min(due + ahead, 2 * back.reached))
        bound, newest = F.col("bound"), F.col("made") == made
        pool = table().where((bound <= upto) & (newest | (bound > before)))
        last = links.select(F.col("source").alias("last"), F.col("target").alias("next"))
        grown = spread(pool, last, "last").where(
            (F.col("next") == F.col("start")) | ((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next"))))
        steps = back.rows().select("start", F.col("last").alias("next"), "back")
        beyond = F.lit(None).cast("int") if back.ended else F.lit(back.reached + 1)
        closes = F.col("next") == F.col("start")
        rows = spread(grown, steps, ["start", "next"], "left").select(
            "p", "start", F.when(closes, F.col("path")).otherwise(F.array_append("path", F.col("next"))).alias("path"),
            F.col("next").alias("last"), (F.size("path") + F.coalesce("back", beyond)).alias("bound"), closes.alias("closed"),
            F.lit(made + 1).alias("made"),
        ).where("bound IS NOT NULL")
        seen, before, made = Observation(), upto, made + 1
        rows.observe(seen, F.min(F.when(~F.col("closed"), F.col("bound"))).alias("due"), F.count_if("closed").alias("closed"),
                     F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
        due = seen.get["due"]
        if seen.get["closed"]:
            spark.read.schema(row).parquet(path).where(F.col("closed") & (F.col("made") == made)).select(
                "p", F.size("path").alias("len"), "path").write.mode("append").parquet(shut)
            if limit is not None:
                # a project may stop once its (cap + 1)th cycle is no longer than what is still due
                w = Window.partitionBy("p").orderBy("len")
                done = cut(
                    found().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit + 1)
                    .groupBy("p").agg(F.max("len").alias("enough"), F.count(F.lit(1)).alias("n"))
                    .where(F.col("n") > limit).drop("n")
                )
        if due is None or due > upto:  # all that was due is extended: the next lengths are those of rows left before
            due = table().where(bound > upto).agg(F.min("bound").alias("due")).first().due
        ahead = 2 * ahead if seen.get["n"] <= ROUND_ROWS else AHEAD
    steps = found().withColumn("_cycle", F.monotonically_increasing_id()).select(
        "_cycle", "len", F.posexplode("path").alias("at", "id"))
    spelt = spread(cut(steps), names, "id").groupBy(KEY, "_cycle", "len").agg(F.sort_array(F.collect_list(F.struct("at", "node_id"))).alias("_path"))
    return spelt.select(KEY, "len", F.col("_path.node_id").alias("path"))


def listed_cycles(found: DataFrame, limit: int = MAX_CYCLES) -> DataFrame:
    """(project_id, cycle_id, len, chain): the shortest ``limit`` of cycles found with that limit or a higher one, chain closed."""
    w = Window.partitionBy(KEY).orderBy("len", "path")
    return (
        found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
        .select(
            KEY, F.concat(F.lit("cycle-"), (F.col("rn") - 1).cast("string")).alias("cycle_id"), "len",
            F.array_append("path", F.col("path")[0]).alias("chain"),
        )
    )


def truncated_projects(found: DataFrame, limit: int = MAX_CYCLES) -> DataFrame:
    """(project_id, n_found, truncated)."""
    return found.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).select(
        KEY, F.least("n", F.lit(limit)).alias("listed"), (F.col("n") > limit).alias("truncated")
    )


def nodes_in_listed(cycles: DataFrame) -> DataFrame:
    return cycles.select(
        KEY, F.explode(F.slice("chain", F.lit(1), F.size("chain") - 1)).alias("node_id")
    ).distinct()


def chain_edges(cycles: DataFrame) -> DataFrame:
    n = F.size("chain") - 1
    pairs = F.arrays_zip(F.slice("chain", F.lit(1), n).alias("s"), F.slice("chain", F.lit(2), n).alias("t"))
    return cycles.select(KEY, F.explode(pairs).alias("p")).select(
        KEY, F.col("p.s").alias("source"), F.col("p.t").alias("target")
    ).distinct()


def components_of_cycles(cycles: DataFrame) -> DataFrame:
    """Cyclic components rebuilt from a cycle list, for baselines that lack them."""
    return strong_components(chain_edges(cycles))


def cycle_edge_flags(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Edges with ``in_cycle``: both ends in some cycle."""
    members = scc.select(KEY, "node_id").distinct()
    out = edges
    for end in ("source", "target"):
        m = members.select(KEY, F.col("node_id").alias(end), F.lit(True).alias(f"_{end}"))
        out = spread(out, m, [KEY, end], "left")
    return out.withColumn(
        "in_cycle", F.col("_source").isNotNull() & F.col("_target").isNotNull()
    ).select(*edges.columns, "in_cycle")
