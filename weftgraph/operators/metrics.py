"""Degrees, centrality and totals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.functions import architecture, numbers, risk
from weftgraph.operators import packs
from weftgraph.operators.components import component_sizes, parts
from weftgraph.session import cut, scratch_path

KEY = "project_id"
BETWEENNESS_LIMIT = 1500  # fixed value of the service: larger projects are marked as skipped there


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, node_id, in_degree, out_degree), zero-degree nodes included.

    Ends are counted before the shuffle, so a file everybody imports is no hot key.
    """
    ends = edges.select(
        KEY, F.explode(F.array(
            F.struct(F.col("source").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            F.struct(F.col("target").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        )).alias("e")
    ).select(KEY, "e.*")
    none = nodes.select(KEY, "node_id", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return ends.unionByName(none).groupBy(KEY, "node_id").agg(
        F.sum("i").cast("int").alias("in_degree"), F.sum("o").cast("int").alias("out_degree")
    )


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))


def degree_centrality(degree: DataFrame) -> DataFrame:
    """Adds ``degree_centrality``: (in+out)/(n-1), 1 in a project of one file."""
    scale = F.lit(1.0) / (F.col("n") - 1)
    value = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(
        (F.col("in_degree") + F.col("out_degree")) * scale
    )
    return degree.join(node_counts(degree), KEY).withColumn("degree_centrality", value).drop("n")


BATCH_ROWS = 50_000_000  # (root, node) rows that one batch of roots may hold
SHARES = 1 << 30  # parts that the roots are dealt into by a hash
MANY, FEW = 1_000_000, 0.05  # a level is small below this share of a batch, if the batch has many rows
STRIDE, SLACK = 16, 1.25  # a batch has this many times the roots of all before it at most; the last may be larger by the slack


def _flows(links: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """(node, flow): what shortest paths from ``roots(root)`` add to each node between their ends; ``links(node, target)``.

    Also the number of (root, node) rows there were. Paths of all roots advance together, one level per job, and their shares are then
    summed level by level from the far end. All levels are appended to one table.
    """
    spark = links.sparkSession
    path, row = scratch_path(spark, "levels"), "root bigint, node bigint, sigma double, level int"
    walked = lambda: spark.read.schema(row).parquet(path)
    level = lambda k: walked().where(F.col("level") == k).drop("level")
    count = Observation()
    roots.select("root", F.col("root").alias("node"), F.lit(1.0).alias("sigma"), F.lit(0).alias("level")).observe(
        count, F.count(F.lit(1)).alias("n")).write.parquet(path)
    depth, held, last = 0, count.get["n"], count.get["n"]
    while True:
        count = Observation()
        seen = walked().select("root", "node")
        if held > MANY and last < FEW * held:  # most roots are through: only the rows of the others are compared
            seen = seen.join(cut(level(depth).select("root").distinct()), "root", "left_semi")
        fresh = (
            level(depth).join(links, "node").groupBy("root", F.col("target").alias("node")).agg(F.sum("sigma").alias("sigma"))
            .join(seen, ["root", "node"], "left_anti").withColumn("level", F.lit(depth + 1))
        )
        fresh.observe(count, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
        if not (last := count.get["n"]):
            break
        held += last
        depth += 1
    shares, given = scratch_path(spark, "shares"), "root bigint, node bigint, sigma double, delta double, level int"
    told = lambda: spark.read.schema(given).parquet(shares)
    level(depth).select("root", "node", "sigma", F.lit(0.0).alias("delta"), F.lit(depth).alias("level")).write.parquet(shares)  # the deepest passes nothing on
    for k in range(depth - 1, 0, -1):
        back = told().where(F.col("level") == k + 1).select(
            "root", F.col("node").alias("target"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        summed = level(k).join(links, "node").join(back, ["root", "target"]).groupBy("root", "node").agg(
            F.sum(F.col("sigma") * F.col("share")).alias("delta"))
        level(k).join(summed, ["root", "node"], "left").select(
            "root", "node", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"), F.lit(k).alias("level")).write.mode("append").parquet(shares)
    return told().where(F.col("node") != F.col("root")).groupBy("node").agg(F.sum("delta").alias("flow")), held


def _flows_of(pack: packs.Pack) -> Iterator[pa.RecordBatch]:
    """(project_id, node_id, raw): what shortest paths from the roots of this task add to each node between their ends."""
    walks, raw = packs.Walks(pack, pack.source, pack.target), np.zeros(pack.n)
    roots = np.flatnonzero(pack.mine() & (np.bincount(pack.source, minlength=pack.n) > 0))
    for some, base, total in walks.batches(roots):
        flow = packs.flows(walks, some, base, total)
        places = np.flatnonzero(flow)
        raw += np.bincount(walks.nodes(some, base, places)[1], flow[places], pack.n)
    yield pa.RecordBatch.from_arrays([pack.projects, pack.names, pa.array(raw)], names=[KEY, "node_id", "raw"])


def betweenness(
    nodes: DataFrame, edges: DataFrame, limit: int | None = None, batch_rows: int = BATCH_ROWS, whole: int = 0,
) -> DataFrame:
    """(project_id, node_id, betweenness): shortest-path betweenness, NULL above ``limit`` nodes if one is given.

    Parts of up to ``whole`` edges are held by a task, which walks from each of their files. In the others files are numbered, and roots go in
    batches dealt by a hash. The first has as many as keep its (root, node) rows at about ``batch_rows`` if every
    root reached all of its project; what its roots have reached tells how many the next may have. A batch leaves one row per file.
    """
    sizes = node_counts(nodes)
    small = sizes if limit is None else sizes.where(F.col("n") <= limit)
    # loops and isolated files lie on no shortest path
    named = cut(
        edges.where(F.col("source") != F.col("target")).join(small, KEY, "left_semi")
        .select(KEY, "source", "target").distinct()
    )
    sums = None
    if whole:
        held = parts(named, whole)
        sums = held.in_tasks(f"{KEY} string, node_id string, raw double", _flows_of).groupBy(KEY, "node_id").agg(F.sum("raw").alias("raw"))
        named = held.large
    if named is not None:
        far = _flows_in_batches(named, batch_rows)
        sums = far if sums is None else sums.unionByName(far)
    raw = F.coalesce("raw", F.lit(0.0))
    scaled = F.when(F.col("n") > 2, raw / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(raw)
    return nodes.select(KEY, "node_id").join(sizes, KEY).join(sums, [KEY, "node_id"], "left").select(
        KEY, "node_id", (scaled if limit is None else F.when(F.col("n") <= limit, scaled)).alias("betweenness"))


def _flows_in_batches(named: DataFrame, batch_rows: int) -> DataFrame:
    """(project_id, node_id, raw) of all files that shortest paths pass; ``named`` are the edges, each once and without loops."""
    names = cut(named.select(KEY, F.explode(F.array("source", "target")).alias("node_id")).distinct().withColumn(
        "id", F.monotonically_increasing_id()))
    links = named
    for end in ("source", "target"):
        links = links.join(names.select(KEY, F.col("node_id").alias(end), F.col("id").alias(f"_{end}")), [KEY, end])
    links = cut(links.select(F.col("_source").alias("node"), F.col("_target").alias("target")))
    roots = links.select(F.col("node").alias("root")).distinct()
    rows = names.groupBy(KEY).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("rows")).first().rows
    share = max(1, min(SHARES, math.floor(SHARES * batch_rows / (rows or 1))))
    total = scratch_path(named.sparkSession, "flows")
    dealt, held = 0, 0
    while dealt < SHARES:
        place = F.pmod(F.xxhash64("root"), F.lit(SHARES))
        found, reached = _flows(links, roots.where((place >= dealt) & (place < dealt + share)))
        found.write.mode("append").parquet(total)
        dealt, held = dealt + share, held + reached
        # as many roots as reach batch_rows at the rate so far
        share = max(1, min(STRIDE * dealt, math.floor(dealt * batch_rows / max(held, 1))))
        share = SHARES - dealt if SHARES - dealt <= SLACK * share else share
    flows = named.sparkSession.read.schema("node bigint, flow double").parquet(total).groupBy(F.col("node").alias("id")).agg(F.sum("flow").alias("raw"))
    return names.join(flows, "id").select(KEY, "node_id", "raw")


def graph_totals(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per project. ``avg_raw`` is the unrounded average out-degree."""
    comps = component_sizes(labels).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("component_count"), F.max("size").alias("largest_component")
    )
    counts = edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("m"))
    m = F.coalesce("m", F.lit(0))
    return (
        node_counts(nodes).join(counts, KEY, "left").join(comps, KEY, "left")
        .select(
            KEY, F.col("n").alias("file_count"), m.alias("edge_count"), "component_count",
            "largest_component", numbers.hundredths(m / F.col("n")).alias("avg_dependencies"),
            (m / F.col("n")).alias("avg_raw"), (F.col("n") > BETWEENNESS_LIMIT).alias("betweenness_skipped"),
        )
    )


def node_table(nodes: DataFrame, edges: DataFrame, scc: DataFrame, **per_node: DataFrame) -> DataFrame:
    """The wide per-file row: degrees, centrality, cycle flag, category, risk, and
    any further ``(project_id, node_id, value…)`` tables given by keyword."""
    members = scc.select(KEY, "node_id").distinct().withColumn("in_cycle", F.lit(True))
    wide = (
        nodes.join(degree_centrality(degrees(nodes, edges)), [KEY, "node_id"])
        .join(members, [KEY, "node_id"], "left")
        .withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    )
    for extra in per_node.values():
        wide = wide.join(extra, [KEY, "node_id"], "left")
    return wide.withColumn("category", architecture.category(F.col("node_id"))).transform(risk.with_risk)
