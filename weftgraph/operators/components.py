"""Weakly and strongly connected components, and the order between them.

All loops work on every project at once and cut lineage with written tables,
so a lost executor costs a re-read and not a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import condense, packs
from weftgraph.session import cut, cut_count, cut_measure, spread

KEY = "project_id"
ROUND_LIMIT = 100_000


def _relabel(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace ``column`` by its image under ``mapping(project_id, c, m)``; unmapped stays."""
    m = mapping.select(KEY, F.col("c").alias(column), F.col("m").alias("_m"))
    return spread(df, m, [KEY, column], "left").withColumn(column, F.coalesce("_m", column)).drop("_m")


def _compress(mapping: DataFrame) -> DataFrame:
    """Follow a forest of pointers to its roots, two jumps per job."""
    while True:
        once = _relabel(mapping.withColumn("old", F.col("m")), "m", mapping)
        twice = _relabel(once, "m", mapping)
        mapping, seen = cut_measure(twice, moved=F.sum((F.col("m") != F.col("old")).cast("int")))
        mapping = mapping.drop("old")
        if not seen["moved"]:
            return mapping


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, node_id, component): component is its smallest node id.

    Each round hooks every component to its smallest neighbour and contracts,
    so the number of rounds grows with the logarithm of the graph's size.
    """
    # Every pair is listed once; the hook below looks at it from both ends.
    pair = F.array_sort(F.array("source", "target"))
    links, left = cut_count(
        edges.where(F.col("source") != F.col("target"))
        .select(KEY, pair[0].alias("a"), pair[1].alias("b")).distinct()
    )
    steps = []
    while left:
        # the larger end of a link always has a smaller neighbour to hook to
        hook = links.groupBy(KEY, F.col("b").alias("c")).agg(F.min("a").alias("m"))
        hook = _compress(hook)
        steps.append(hook)
        moved = _relabel(_relabel(links, "a", hook), "b", hook)
        pair = F.array_sort(F.array("a", "b"))
        links, left = cut_count(
            moved.where(F.col("a") != F.col("b"))
            .select(KEY, pair[0].alias("a"), pair[1].alias("b")).distinct()
        )
    labels = nodes.select(KEY, "node_id", F.col("node_id").alias("component"))
    for step in steps:
        labels = _relabel(labels, "component", step)
    return labels


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy(KEY, "component").agg(F.count(F.lit(1)).alias("size"))


def _trim(links: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Drop edges that cannot lie on a cycle: two peeling steps from both ends per job. Numbered links have no project."""
    key = [c for c in links.columns if c == KEY]

    def peel(df):
        heads = df.select(*key, F.col("target").alias("source")).distinct()
        tails = df.select(*key, F.col("source").alias("target")).distinct()
        return spread(spread(df, heads, [*key, "source"], "left_semi"), tails, [*key, "target"], "left_semi")

    while count:
        links, now = cut_count(peel(peel(links)).select(*key, "source", "target"))
        # Peeling only saves work; long thin tails are left to the labels below.
        if now > 0.9 * count:
            return links, now
        count = now
    return links, 0


def _spread(state: DataFrame, both: DataFrame) -> DataFrame:
    """One step of the two labels along the edges; ``f0``/``b0`` are carried along.

    ``both`` holds each edge twice, so one join sends f forward and b back.
    """
    sent = spread(both, state.select(F.col("node").alias("src"), "f", "b"), "src").select(
        F.col("dst").alias("node"),
        F.when(F.col("forward"), F.col("f")).alias("f"), F.when(~F.col("forward"), F.col("b")).alias("b"),
    )
    return (
        state.unionByName(sent, allowMissingColumns=True).groupBy("node")
        .agg(*[F.min(c).alias(c) for c in ("f", "b", "f0", "b0")])
    )


def _jump(state: DataFrame, known: DataFrame) -> DataFrame:
    """The label of my label also holds for me; ``known`` may be an older state."""
    ahead = spread(state, known.select(F.col("node").alias("f"), F.col("f").alias("ff")), "f")
    both = spread(ahead, known.select(F.col("node").alias("b"), F.col("b").alias("bb")), "b")
    return both.select("node", F.least("f", "ff").alias("f"), F.least("b", "bb").alias("b"), "f0", "b0")


def _two_way_labels(links: DataFrame, salt: int) -> DataFrame:
    """(node, f, b): the least node that reaches it, and the least node it reaches.

    "Least" is by the node number under a mask that changes with ``salt``,
    which keeps the expected number of passes logarithmic. Labels are longs,
    so the minima are hash aggregates. A label is a node with labels of its
    own, so each job also jumps through it.
    """
    mask = (salt * 0x9E3779B97F4A7C15) % (1 << 63)
    masked = lambda c: F.col(c).bitwiseXOR(F.lit(mask).cast("bigint"))
    both = cut(links.select(F.explode(F.array(
        F.struct(masked("source").alias("src"), masked("target").alias("dst"), F.lit(True).alias("forward")),
        F.struct(masked("target").alias("src"), masked("source").alias("dst"), F.lit(False).alias("forward")),
    )).alias("e")).select("e.*"))
    state = both.select(F.col("src").alias("node")).distinct().withColumns(
        {"f": F.col("node"), "b": F.col("node")}
    )
    for _ in range(ROUND_LIMIT):
        old = state.withColumns({"f0": F.col("f"), "b0": F.col("b")})
        stepped = _spread(_jump(_spread(old, both), state), both)
        changed = F.sum(((F.col("f") != F.col("f0")) | (F.col("b") != F.col("b0"))).cast("int"))
        state, seen = cut_measure(stepped, changed=changed)
        state = state.drop("f0", "b0")
        if not seen["changed"]:
            return state.select(*[masked(c).alias(c) for c in ("node", "f", "b")])
    raise RuntimeError(f"labels did not settle in {ROUND_LIMIT} rounds")


MEMBERS = f"{KEY} string, component_id string, node_id string"


def _members(pack: packs.Pack) -> Iterator[pa.RecordBatch]:
    """Strong components of two nodes at least."""
    home = packs.strong(pack)
    node = np.flatnonzero(np.bincount(home, minlength=pack.n)[home] > 1)
    yield pa.RecordBatch.from_arrays(
        [pack.projects.take(pa.array(node)), pack.names.take(pa.array(home[node])), pack.names.take(pa.array(node))],
        names=[KEY, "component_id", "node_id"])


def strong_components(edges: DataFrame) -> DataFrame:
    """(project_id, component_id, node_id) of every component that holds a cycle.

    component_id is its smallest node. A project or weak component that a task holds whole is walked there. In the others, nodes whose two labels
    agree form one component with the label; the other edges can only be inside a component
    when both ends carry the same pair of labels, which shrinks the rest.
    """
    loops = edges.where(F.col("source") == F.col("target")).select(
        KEY, F.col("source").alias("component_id"), F.col("source").alias("node_id")
    )
    links = edges.where(F.col("source") != F.col("target")).select(KEY, "source", "target").distinct()
    held = parts(cut(links), packs.EDGES_IN_TASK)
    held.sizes = None  # the work does not grow with the square
    grouped = held.in_tasks(MEMBERS, _members)
    if held.large is not None:
        large = _labelled(*_trim(*cut_count(held.large)))
        grouped = grouped if large is None else grouped.unionByName(large)
    grouped = cut(grouped)
    alone = spread(loops, grouped.select(KEY, "node_id"), [KEY, "node_id"], "left_anti")
    return cut(grouped.select(KEY, "component_id", "node_id").unionByName(alone.select(KEY, "component_id", "node_id")))


def _labelled(links: DataFrame, left: int) -> DataFrame | None:
    """Strong components of two nodes at least by two labels, none if no edge is left."""
    found, names = [], None
    if left:
        # From here on nodes are numbers, unique over all projects; the table is written, so they are stable.
        names = cut(
            links.select(KEY, F.explode(F.array("source", "target")).alias("node_id")).distinct()
            .withColumn("id", F.monotonically_increasing_id())
        )
        for end in ("source", "target"):
            number = names.select(KEY, F.col("node_id").alias(end), "id")
            links = spread(links, number, [KEY, end]).drop(end).withColumnRenamed("id", end)
        links = cut(links.select("source", "target"))
    while left:
        state = _two_way_labels(links, salt=len(found))
        found.append(
            state.where(F.col("f") == F.col("b")).select(F.col("f").alias("pivot"), F.col("node").alias("id"))
        )
        rest = state.where(F.col("f") != F.col("b"))
        a = rest.select(F.col("node").alias("source"), "f", "b")
        z = rest.select(F.col("node").alias("target"), "f", "b")
        links, left = cut_count(
            spread(spread(links, a, "source"), z, ["target", "f", "b"])
            .select("source", "target")
        )
        links, left = _trim(links, left)
    if not found:
        return None
    members = found[0]
    for more in found[1:]:
        members = members.unionByName(more)
    members = spread(members, names, "id")
    real = members.groupBy(KEY, "pivot").agg(
        F.min("node_id").alias("component_id"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").drop("n")
    return spread(members, real, [KEY, "pivot"]).select(KEY, "component_id", "node_id")


def component_summary(scc: DataFrame) -> DataFrame:
    """(project_id, component_id, size) — rank with ORDER BY size DESC, component_id."""
    return scc.groupBy(KEY, "component_id").agg(F.count(F.lit(1)).alias("size"))


@dataclass
class Parts:
    """Edges dealt by part: a project, or in projects of too many edges a weak component.

    ``small(project_id, part, source, target)`` are those of parts that one task holds, ``count`` of them with the copies that several tasks get;
    ``large(project_id, source, target)`` those of all others, if there are any. ``labels(project_id, node_id, part)`` has the nodes of projects
    that were taken apart, ``wide(project_id, part)`` their large parts, ``sizes(project_id, part, n)`` the small parts that several tasks share.
    """

    small: DataFrame
    count: int
    large: DataFrame | None
    labels: DataFrame | None
    wide: DataFrame | None
    sizes: DataFrame | None

    def place(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """``nodes(project_id, node_id)`` with their small part, and those of large parts."""
        if self.labels is None:
            return nodes.withColumn("part", F.lit("")), None
        placed = nodes.join(self.labels, [KEY, "node_id"], "left").withColumn("part", F.coalesce("part", F.lit("")))
        if self.large is None:
            return placed, None
        return placed.join(self.wide, [KEY, "part"], "left_anti"), placed.join(self.wide, [KEY, "part"], "left_semi").select(KEY, "node_id")

    def in_tasks(self, schema: str, work: Callable[[packs.Pack], Iterator[pa.RecordBatch]], asked: DataFrame | None = None) -> DataFrame:
        """What ``work`` makes of the small parts, with nodes ``asked(project_id, part, node_id)``."""
        rows = self.small
        if asked is not None:
            rows = rows.unionByName(asked.select(KEY, "part", F.col("node_id").alias("source"), F.lit(None).cast("string").alias("target")))
        if self.sizes is not None:
            shares = F.coalesce(F.ceil(F.col("n") * F.col("n") / packs.STEPS_IN_TASK), F.lit(1)).cast("int")
            rows = rows.join(self.sizes, [KEY, "part"], "left").withColumn("shares", shares).withColumn(
                "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("n")
        return packs.in_tasks(rows, self.count, schema, work)


LINKS_IN_TASK = 2_000_000  # links between numbers that one task holds


def _united(rows: pa.Table) -> pa.Table:
    """(project_id, h, part) of a project's numbers; the part is the least of those that links ``a`` to ``b`` join."""
    ends = np.concatenate([np.asarray(rows[c].combine_chunks()) for c in ("a", "b")])
    every, number = np.unique(ends, return_inverse=True)
    label = packs.weak(len(every), number[: rows.num_rows], number[rows.num_rows:])
    project = rows[KEY].combine_chunks().take(pa.array(np.zeros(len(every), np.int64)))
    return pa.table({KEY: project, "h": pa.array(every), "part": pa.array(every[label]).cast(pa.string())})


def _weak_labels(nodes: DataFrame, edges: DataFrame, huge: DataFrame | None) -> DataFrame:
    """(project_id, node_id, part): files that edges join have the same part.

    Files are taken for the hashes of their names, so that a task holds the links of a project; two that share a hash share a part, which may be
    more than a weak component then. Projects in ``huge`` have too many links for a task.
    """
    some = lambda df, how: df if huge is None else df.join(huge, KEY, how)
    h = F.xxhash64
    united = some(edges, "left_anti").select(KEY, h("source").alias("a"), h("target").alias("b")).groupBy(KEY).applyInArrow(
        _united, f"{KEY} string, h bigint, part string")
    labels = spread(some(nodes, "left_anti").withColumn("h", h("node_id")), united, [KEY, "h"], "left").select(
        KEY, "node_id", F.coalesce("part", "node_id").alias("part"))
    if huge is None:
        return labels
    far = weak_components(some(nodes, "left_semi"), some(edges, "left_semi"))
    return labels.unionByName(far.select(KEY, "node_id", F.col("component").alias("part")))


def parts(edges: DataFrame, most: int, nodes: DataFrame | None = None, labels: DataFrame | None = None) -> Parts:
    """Edges of parts of up to ``most`` edges, and the others. ``nodes(project_id, node_id)`` are placed though they may have no edge.

    ``labels(project_id, node_id, part)`` say what weak component a node is in, if that is known.
    """
    edges = edges.where(F.col(KEY).isNotNull() & F.col("source").isNotNull() & F.col("target").isNotNull()).select(KEY, "source", "target")
    n, fits = F.col("n"), F.col("n") <= most
    copies = F.sum(F.when(fits, n * F.ceil(n * n / packs.STEPS_IN_TASK)))
    measures = {"small": copies, "large": F.count_if(~fits), "huge": F.count_if(n > LINKS_IN_TASK), "top": F.max(F.when(fits, n))}
    sizes, seen = cut_measure(edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")), **measures)
    count, top = seen["small"] or 0, seen["top"] or 0
    small, large, wide = edges.withColumn("part", F.lit("")), None, None
    sizes = sizes.withColumn("part", F.lit(""))
    if seen["large"]:
        big, huge = sizes.where(~fits).select(KEY), sizes.where(n > LINKS_IN_TASK).select(KEY) if seen["huge"] else None
        rest = edges.join(big, KEY, "left_semi")
        small, sizes = small.join(big, KEY, "left_anti"), sizes.where(fits)
        if labels is None:
            ends = rest.select(KEY, F.explode(F.array("source", "target")).alias("node_id"))
            if nodes is not None:
                ends = ends.unionByName(nodes.select(KEY, "node_id").where("node_id IS NOT NULL").join(big, KEY, "left_semi"))
            labels = _weak_labels(cut(ends.distinct()), rest, huge)
        labels = cut(labels.join(big, KEY, "left_semi").select(KEY, "node_id", "part"))
        rest = cut(spread(rest, labels.select(KEY, F.col("node_id").alias("source"), "part"), [KEY, "source"]))
        of_parts, seen = cut_measure(rest.groupBy(KEY, "part").agg(F.count(F.lit(1)).alias("n")), **measures)
        count, top = count + (seen["small"] or 0), max(top, seen["top"] or 0)
        if seen["large"]:
            wide = of_parts.where(~fits).select(KEY, "part")
            large = rest.join(wide, [KEY, "part"], "left_semi").select(KEY, "source", "target")
            rest = rest.join(wide, [KEY, "part"], "left_anti")
        small, sizes = small.unionByName(rest), sizes.unionByName(of_parts.where(fits))
    else:
        labels = None
    shared = sizes.where(n * n > packs.STEPS_IN_TASK) if top * top > packs.STEPS_IN_TASK else None
    return Parts(small.select(KEY, "part", "source", "target"), count, large, labels, wide, shared)


def _chains(pack: packs.Pack) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pack.projects, pack.names, pa.array(packs.depths(pack))], names=[KEY, "c", "depth"])


def dependency_depth(nodes: DataFrame, edges: DataFrame, scc: DataFrame) -> DataFrame:
    """(project_id, node_id, depth): longest chain of dependencies, cycles count as one stop.

    A component is as deep as its longest chain of components. Parts of their graph that a task holds are followed there; in the others
    links settle and chains halve together, see ``condense``.
    """
    graph = condense.condensed(nodes, edges, scc)
    held = parts(cut(graph.links), packs.EDGES_IN_TASK)
    held.sizes = None  # the work does not grow with the square
    lengths = held.in_tasks(f"{KEY} string, c string, depth bigint", _chains)
    if held.large is not None:
        lengths = lengths.unionByName(condense.chain_lengths(cut(held.large)))
    return graph.members.join(lengths, [KEY, "c"], "left").select(
        KEY, "node_id", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))
