"""Parts of graphs that a task holds whole.

A loop of Spark jobs pays for every round, however few rows it has. A part (a project, a component) of a bounded number of edges needs no
rounds: its edges meet in one task, which works on arrays. Parts above the bound are left to the loops.

``in_tasks`` deals the rows and calls the work with one ``Pack`` after the other: whole parts, together about ``PACK`` rows, so that memory is
bounded by the largest part and many small ones cost one call. Names are numbered by part and code point.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.memory import give_back

KEY = "project_id"
EDGES_IN_TASK = 200_000  # edges of a part that one task holds
PACK = 50_000  # rows of small parts that are worked on together
ROWS_IN_TASK = 500_000  # rows that are dealt to one task, about
STEPS_IN_TASK = 1_000_000_000  # steps from all nodes of a part, beyond which several tasks share them
STATES = 2_000_000  # (root, node) and (root, edge) pairs of the walks that a task makes at once
HANDED = 1 << 18  # rows handed on at once


class Pack:
    """Parts held whole. ``source`` and ``target`` are node numbers of the edges; ``asked`` those of rows without a target.

    ``part`` numbers the part of each node, ``projects``, ``parts`` and ``names`` say what they are called; neighbours in number are neighbours in
    (part, name).
    ``shares`` and ``share`` are, for each node, the number of tasks that its part was given to and which of them this one is.
    """

    def __init__(self, rows: pa.Table):
        one = lambda name: rows[name].combine_chunks()
        projects, parts, source, target = (one(c) for c in (KEY, "part", "source", "target"))
        codes = [np.asarray(c.dictionary_encode().indices) for c in (projects, parts)]
        numbers = [np.asarray(one(c)) for c in ("shares", "share")]
        key = [*codes, numbers[1]]
        new = np.zeros(rows.num_rows, bool)
        for c in key:
            new[1:] |= c[1:] != c[:-1]
        run = np.cumsum(new)  # rows come sorted by part
        new[:1] = True
        first = np.flatnonzero(new)
        edge = np.asarray(target.is_valid())
        ends = pa.concat_arrays([source, target.filter(pa.array(edge))])
        names = ends.dictionary_encode()
        order = np.asarray(pc.sort_indices(names.dictionary))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = np.concatenate((run, run[edge])) * max(1, len(order)) + rank[np.asarray(names.indices)]
        every, number = np.unique(place, return_inverse=True)
        self.n = len(every)
        self.part = every // max(1, len(order))
        self.names = names.dictionary.take(pa.array(order[every % max(1, len(order))]))
        self.projects, self.parts = (c.take(pa.array(first[self.part])) for c in (projects, parts))
        self.shares, self.share = (x[first[self.part]] for x in numbers)
        of_source = number[: rows.num_rows]
        self.source, self.target = of_source[edge], number[rows.num_rows:]
        self.asked = of_source[~edge]

    def mine(self) -> np.ndarray:
        """For each node, whether this task works on it, if its part was given to several."""
        first = np.searchsorted(self.part, self.part)
        return (np.arange(self.n) - first) % self.shares == self.share


class Steps:
    """Where each of ``n`` nodes leads to."""

    def __init__(self, n: int, source: np.ndarray, target: np.ndarray):
        order = np.lexsort((target, source))
        self.ends = target[order]
        self.first = np.searchsorted(source[order], np.arange(n + 1))

    def ahead(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each step from a node of ``at``: the place of that node in ``at``, and where the step leads."""
        many = self.first[at + 1] - self.first[at]
        came = np.repeat(np.arange(len(at)), many)
        skip = np.repeat(self.first[at] - (np.cumsum(many) - many), many)
        return came, self.ends[np.arange(len(came)) + skip]


def in_tasks(rows: DataFrame, count: int, schema: str, work: Callable[[Pack], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``work`` makes of ``rows(project_id, part, source, target)``, ``count`` of them; rows without a target only name a node.

    Rows may have ``shares`` and ``share`` besides, if a part goes to several tasks that work on some of its nodes each.
    """
    whole = {"shares": F.lit(1), "share": F.lit(0)} if "share" not in rows.columns else {}
    rows = rows.withColumns(whole).select(KEY, "part", "source", "target", F.col("shares").cast("int"), F.col("share").cast("int"))
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / ROWS_IN_TASK))
    by = (KEY, "part", "share")
    pack = PACK

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < pack:
                continue
            table = pa.Table.from_batches(held)
            last = table.slice(size - 1)
            other = np.zeros(size, bool)
            for c in by:  # all but the last part are complete
                other |= np.asarray(pc.not_equal(table[c], last[c][0]))
            cut_at = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if cut_at:
                yield from work(Pack(table.slice(0, cut_at)))
                held, size = table.slice(cut_at).to_batches(), size - cut_at
        if size:
            yield from work(Pack(pa.Table.from_batches(held)))
        give_back()

    return rows.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, schema)


def strong(pack: Pack) -> np.ndarray:
    """For each node the least number of its strong component."""
    steps = Steps(pack.n, pack.source, pack.target)
    first, ends = steps.first.tolist(), steps.ends.tolist()
    seen, low, home = [0] * pack.n, [0] * pack.n, [-1] * pack.n
    open_, clock = [], 0
    for root in range(pack.n):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        open_.append(root)
        way, at = [root], [first[root]]
        while way:
            u, i = way[-1], at[-1]
            if i < first[u + 1]:
                at[-1] += 1
                v = ends[i]
                if not seen[v]:
                    clock += 1
                    seen[v] = low[v] = clock
                    open_.append(v)
                    way.append(v)
                    at.append(first[v])
                elif home[v] < 0 and seen[v] < low[u]:
                    low[u] = seen[v]
                continue
            way.pop()
            at.pop()
            if way and low[u] < low[way[-1]]:
                low[way[-1]] = low[u]
            if low[u] == seen[u]:
                of = len(open_) - 1
                while open_[of] != u:
                    of -= 1
                least = min(open_[of:])
                for v in open_[of:]:
                    home[v] = least
                del open_[of:]
    return np.array(home, np.int64)


def weak(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least number of its weak component."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        least = np.minimum(x, y)
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


class Walks:
    """Walks from ``roots`` of a pack, all at once in batches of about ``STATES`` pairs. ``steps`` are the edges that they follow.

    A pair (root, node) has a place among the pairs of its batch: ``base`` of the root, and ``pos`` of the node in its weak component.
    """

    def __init__(self, pack: Pack, source: np.ndarray, target: np.ndarray):
        self.steps = Steps(pack.n, source, target)
        label = weak(pack.n, source, target)
        self.order = np.argsort(label, kind="stable")
        sizes = np.bincount(label, minlength=pack.n)
        self.size = sizes[label]
        self.first = (np.cumsum(sizes) - sizes)[label]
        self.pos = np.empty(pack.n, np.int64)
        self.pos[self.order] = np.arange(pack.n)
        self.pos -= self.first
        self.cost = self.size + np.bincount(label[source], minlength=pack.n)[label]

    def batches(self, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Roots, their bases, and the number of pairs."""
        bunch = np.cumsum(self.cost[roots]) // STATES
        for some in np.split(roots, np.flatnonzero(np.diff(bunch)) + 1):
            if len(some):
                sizes = self.size[some]
                yield some, np.cumsum(sizes) - sizes, int(sizes.sum())

    def nodes(self, roots: np.ndarray, base: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which root, and which node, rising ``places`` stand for."""
        at = np.repeat(np.arange(len(roots)), np.diff(np.append(np.searchsorted(places, base), len(places))))
        return at, self.order[places - base[at] + self.first[roots[at]]]


def distances(walks: Walks, roots: np.ndarray, base: np.ndarray, total: int, hops: int | None) -> np.ndarray:
    """Steps from root to node for each pair of a batch, -1 for none within ``hops``."""
    dist, mark = np.full(total, -1, np.int32), np.empty(total, np.int64)
    at, node, hop = np.arange(len(roots)), roots, 0
    dist[base + walks.pos[roots]] = 0
    while len(at) and (hops is None or hop < hops):
        hop += 1
        came, after = walks.steps.ahead(node)
        at = at[came]
        place = base[at] + walks.pos[after]
        new = np.flatnonzero(dist[place] < 0)
        place = place[new]
        mark[place] = new
        once = new[mark[place] == new]  # a node that several steps lead to goes on once
        dist[place] = hop
        at, node = at[once], after[once]
    return dist


def flows(walks: Walks, roots: np.ndarray, base: np.ndarray, total: int) -> np.ndarray:
    """For each pair of a batch what shortest paths from the root add to the node between their ends."""
    dist, mark = np.full(total, -1, np.int32), np.empty(total, np.int64)
    sigma, delta = np.zeros(total), np.zeros(total)
    at, node, hop = np.arange(len(roots)), roots, 0
    own = base + walks.pos[roots]
    dist[own], sigma[own] = 0, 1.0
    place, levels = own, []
    while len(at):
        hop += 1
        came, after = walks.steps.ahead(node)
        at = at[came]
        to = base[at] + walks.pos[after]
        new = np.flatnonzero(dist[to] < 0)
        before, to = place[came[new]], to[new]
        np.add.at(sigma, to, sigma[before])
        mark[to] = new
        once = mark[to] == new
        dist[to] = hop
        levels.append((before, to))
        place, at, node = to[once], at[new[once]], after[new[once]]
    for before, to in reversed(levels):
        np.add.at(delta, before, sigma[before] * ((1 + delta[to]) / sigma[to]))
    delta[own] = 0
    return delta


def depths(pack: Pack) -> np.ndarray:
    """The longest chain of edges from each node; the edges have no cycle."""
    back = Steps(pack.n, pack.target, pack.source)
    left, depth = np.bincount(pack.source, minlength=pack.n), np.zeros(pack.n, np.int64)
    ready = np.flatnonzero(left == 0)
    while len(ready):
        came, before = back.ahead(ready)
        np.maximum.at(depth, before, depth[ready[came]] + 1)
        np.subtract.at(left, before, 1)
        before = np.unique(before)
        ready = before[left[before] == 0]
    return depth
