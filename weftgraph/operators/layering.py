"""Feedback edges: what has to be held back for a left-to-right drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.reach import reach
from weftgraph.session import cut

KEY = "project_id"


def feedback_edges(edges: DataFrame, scc: DataFrame, whole: int = 0) -> DataFrame:
    """Edges with ``is_feedback``; the others form an acyclic graph (loops left out).

    Inside a component files are ordered by distance from its smallest file,
    then by path; an edge that does not go forward in that order is held back.
    Every edge between components is a forward edge. Components of up to ``whole`` edges are walked by a task.
    """
    plain = edges.where(F.col("source") != F.col("target"))
    member = scc.select(KEY, "component_id", "node_id")
    a = member.withColumnRenamed("node_id", "source")
    b = member.withColumnRenamed("node_id", "target")
    inner = plain.select(KEY, "source", "target").join(a, [KEY, "source"]).join(b, [KEY, "target", "component_id"])
    roots = member.select(KEY, F.col("component_id").alias("root")).distinct()
    if whole:
        inner = cut(inner)
    labels = member.withColumnRenamed("component_id", "part")
    place = reach(inner.select(KEY, "source", "target"), roots, whole=whole, labels=labels).select(KEY, "node", "dist")
    if whole:
        place = cut(place)
    flagged = (
        inner.join(place.select(KEY, F.col("node").alias("source"), F.col("dist").alias("ds")), [KEY, "source"])
        .join(place.select(KEY, F.col("node").alias("target"), F.col("dist").alias("dt")), [KEY, "target"])
        .where(F.struct(F.col("ds").alias("d"), F.col("source").alias("n")) > F.struct(F.col("dt").alias("d"), F.col("target").alias("n")))
        .select(KEY, "source", "target", F.lit(True).alias("is_feedback"))
    )
    return plain.select(KEY, "source", "target").join(flagged, [KEY, "source", "target"], "left").withColumn(
        "is_feedback", F.coalesce("is_feedback", F.lit(False))
    )
