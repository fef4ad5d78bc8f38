"""Summaries, filters and listings over the per-file table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import numbers, paths, risk

KEY = "project_id"


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), paths.dirname(path)).otherwise("(root)")


def project_summary(
    wide: DataFrame, edges: DataFrame, cycles: DataFrame, external: DataFrame, unresolved: DataFrame
) -> DataFrame:
    """One row per project; ``cycles`` is the listed table."""
    by = lambda df, name: df.groupBy(KEY).agg(F.count(F.lit(1)).alias(name))
    out = wide.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(F.col("level").isin("High", "Critical")).alias("high_risk_count"),
    )
    for df, name in ((edges, "edge_count"), (cycles, "cycle_count"),
                     (external, "external_count"), (unresolved, "unresolved_count")):
        out = out.join(by(df, name), KEY, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("avg_dependencies", numbers.hundredths(F.col("edge_count") / F.col("file_count")))


def category_histogram(wide: DataFrame) -> DataFrame:
    return wide.groupBy(KEY, "category").agg(F.count(F.lit(1)).alias("files"))


def facets(wide: DataFrame) -> DataFrame:
    """(project_id, facet, value): distinct categories and folders."""
    pairs = F.array(
        F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")),
        F.struct(F.lit("folder").alias("facet"), folder_of(F.col("node_id")).alias("value")),
    )
    return wide.select(KEY, F.explode(pairs).alias("p")).select(KEY, "p.*").distinct()


def facet_filter(
    wide: DataFrame, categories: list[str] | None = None, min_risk: str | None = None,
    folder: str | None = None,
) -> DataFrame:
    """AND across axes; an empty axis does not restrict. Folder means the whole subtree."""
    out = wide
    if categories:
        out = out.where(F.col("category").isin(*categories))
    if min_risk:
        floor = [name for name, _ in risk.LEVELS].index(min_risk)
        out = out.where(risk.rank_of(F.col("level")) >= floor)
    if folder:
        at = folder_of(F.col("node_id"))
        out = out.where((at == folder) | at.startswith(folder.rstrip("/") + "/"))
    return out


def search(nodes: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of the path."""
    return nodes.where(F.contains(F.lower("node_id"), F.lower(F.trim(F.lit(text)))))


def folder_tree(nodes: DataFrame) -> DataFrame:
    """(project_id, parent, name, path, is_file, depth, files): every folder and file.

    ``files`` counts the files below. Listing order is (is_file, name) within a
    parent, so folders come first.
    """
    parts = F.split("node_id", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    )
    return (
        nodes.select(KEY, "node_id", F.explode(prefixes).alias("path"))
        .groupBy(KEY, "path")
        .agg(F.count(F.lit(1)).alias("files"), F.bool_or(F.col("path") == F.col("node_id")).alias("is_file"))
        .select(
            KEY, paths.dirname(F.col("path")).alias("parent"), paths.basename(F.col("path")).alias("name"),
            "path", "is_file", F.size(F.split("path", "/")).alias("depth"), "files",
        )
    )


def imports_panel(edges: DataFrame) -> DataFrame:
    """(project_id, file, direction, other, type, symbols): both sides of every edge."""
    side = lambda me, way, other: F.struct(
        F.col(me).alias("file"), F.lit(way).alias("direction"), F.col(other).alias("other")
    )
    return edges.select(
        KEY, "type", "symbols",
        F.explode(F.array(side("source", "imports", "target"), side("target", "imported_by", "source"))).alias("s"),
    ).select(KEY, "s.*", "type", "symbols")


def focus_start(wide: DataFrame) -> DataFrame:
    """(project_id, node_id): the file a large graph opens on."""
    degree = F.col("in_degree") + F.col("out_degree")
    entry = (F.col("in_degree") == 0) & (F.col("out_degree") > 0)
    order = F.struct(
        (F.col("category") == "Test").alias("test"), (~entry).alias("not_entry"),
        F.when(entry, -F.col("out_degree")).otherwise(0).alias("out"), (-degree).alias("degree"),
        "node_id",
    )
    return wide.groupBy(KEY).agg(F.min(order)["node_id"].alias("node_id"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with ``isolated``: no edge to or from another file."""
    linked = edges.where(F.col("source") != F.col("target")).select(
        KEY, F.explode(F.array("source", "target")).alias("node_id")
    ).distinct().withColumn("_l", F.lit(True))
    return nodes.join(linked, [KEY, "node_id"], "left").withColumn("isolated", F.col("_l").isNull()).drop("_l")


def top_dependents(degree: DataFrame, k: int = 5) -> DataFrame:
    """The k most depended-on files of each project."""
    w = Window.partitionBy(KEY).orderBy(F.desc("in_degree"), "node_id")
    return degree.where(F.col("in_degree") > 0).withColumn("rank", F.row_number().over(w)).where(
        F.col("rank") <= k
    ).select(KEY, "rank", "node_id", "in_degree")
