"""Graph assembly: nodes, edges, external dependencies, unresolved imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import paths

KEY = "project_id"


def edges(resolved: DataFrame) -> DataFrame:
    """One edge per (source, target): first import's type, first-seen symbol union.

    Later symbol lists are filtered against what was there before that list, so
    a duplicate inside one list survives.
    """
    entry = F.struct("merge_order", "type", "symbols")
    return (
        resolved.where(F.col("kind") == "local")
        .groupBy(KEY, F.col("path").alias("source"), "target")
        .agg(F.sort_array(F.collect_list(entry)).alias("seen"))
        .select(
            KEY, "source", "target", F.col("seen")[0]["type"].alias("type"),
            F.aggregate(
                F.slice("seen", F.lit(2), F.size("seen")),
                F.col("seen")[0]["symbols"],
                lambda acc, e: F.concat(
                    acc, F.filter(e["symbols"], lambda s: ~F.array_contains(acc, s))
                ),
            ).alias("symbols"),
        )
    )


def nodes(parsed: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Scanned files, plus resolved targets outside the scan (0 lines, importer's language)."""
    scanned = parsed.select(
        KEY, F.col("path").alias("node_id"), "language", "lines_of_code", F.lit(0).alias("pri")
    )
    outside = edge_table.select(
        KEY, F.col("target").alias("node_id"),
        F.when(F.endswith("source", F.lit(".py")), "python").otherwise("javascript").alias("language"),
        F.lit(0).alias("lines_of_code"), F.lit(1).alias("pri"),
    )
    # One aggregation instead of distinct + anti join; JS files are processed first.
    best = F.min(F.struct("pri", "language", "lines_of_code")).alias("b")
    return (
        scanned.unionByName(outside).groupBy(KEY, "node_id").agg(best)
        .select(KEY, "node_id", paths.basename(F.col("node_id")).alias("name"),
                "b.language", "b.lines_of_code")
    )


def external_deps(resolved: DataFrame) -> DataFrame:
    return (
        resolved.where(F.col("kind") == "external")
        .groupBy(KEY, "specifier").agg(F.count(F.lit(1)).alias("n"))
    )


def unresolved(resolved: DataFrame) -> DataFrame:
    """One row per unresolved occurrence."""
    return resolved.where(F.col("kind") == "unresolved").select(
        KEY, F.col("path").alias("file"), "specifier", "type"
    )


def cross_language(edge_table: DataFrame) -> DataFrame:
    """Edges that join Python to JS/TS by name; empty when resolution is sound."""
    script = r"\.(js|jsx|ts|tsx|mjs|cjs)$"
    a, b = F.col("source"), F.col("target")
    return edge_table.where(
        (a.endswith(".py") & b.rlike(script)) | (a.rlike(script) & b.endswith(".py"))
    )


def induced(edge_table: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in ``keep(project_id, node_id)``."""
    ids = keep.select(KEY, "node_id")
    out = edge_table
    for end in ("source", "target"):
        out = out.join(ids.withColumnRenamed("node_id", end), [KEY, end], "left_semi")
    return out.select(*edge_table.columns)
