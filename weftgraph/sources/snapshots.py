"""Snapshots of an analysis, baselines and node-link rows."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "project_id"


def _at(path: str, part: str, snapshot_id: str) -> str:
    return f"{path}/{part}/snapshot={quote(snapshot_id, safe='')}"


def _committed(spark: SparkSession, path: str, snapshot_id: str) -> str | None:
    """The version of a snapshot that its marker names; None before it is complete."""
    marker = _at(path, "commits", snapshot_id)
    rows = spark.read.schema("version string").parquet(marker).take(1) if _exists(spark, marker) else []
    return rows[0].version if rows else None


def write_snapshot(tables: dict[str, DataFrame], path: str, snapshot_id: str) -> None:
    """Write every table of a snapshot under a fresh version, then the marker that makes this version the one that is read.

    Writing an id again replaces it: readers see the old version until the marker is written, and the old files go afterwards. A job that
    ends half-way leaves what was there before.
    """
    spark = next(iter(tables.values())).sparkSession
    old, version = _committed(spark, path, snapshot_id), uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{_at(path, name, snapshot_id)}/version={version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(_at(path, "commits", snapshot_id))
    for name in tables if old else ():
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{_at(path, name, snapshot_id)}/version={old}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def read_snapshot(spark: SparkSession, path: str, table: str, snapshot_id: str) -> DataFrame:
    """One snapshot's table, by its own folder; an id that was never completed is not there."""
    version = _committed(spark, path, snapshot_id)
    if version is None:
        raise FileNotFoundError(f"snapshot {snapshot_id} is not complete in {path}")
    return spark.read.parquet(f"{_at(path, table, snapshot_id)}/version={version}").withColumn("snapshot_id", F.lit(snapshot_id))


def read_evolved(spark: SparkSession, path: str, schema: T.StructType, defaults: dict) -> DataFrame:
    """Rows of old and new shape under one schema; a column an old row lacks gets its default.

    The expected schema is given, so no footers are merged.
    """
    df = spark.read.schema(schema).parquet(path)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


# --- baselines ---------------------------------------------------------------
# One JSON object per line, one kind of fact per line, so that a project of any
# size can be written in parallel.
BASELINE_LINE = (
    "project_id string, kind string, file_count bigint, edge_count bigint, truncated boolean, "
    "id string, members array<string>, score int"
)


def baseline_lines(
    totals: DataFrame, cycles: DataFrame, scc: DataFrame, risk: DataFrame
) -> DataFrame:
    """Rows of BASELINE_LINE. ``totals`` has file_count, edge_count, truncated."""
    head = totals.select(KEY, F.lit("totals").alias("kind"), "file_count", "edge_count", "truncated")
    listed = cycles.select(KEY, F.lit("cycle").alias("kind"), F.col("cycle_id").alias("id"), F.col("chain").alias("members"))
    comp = scc.select(KEY, F.lit("component").alias("kind"), F.col("component_id").alias("id"),
                      F.array("node_id").alias("members"))
    scores = risk.select(KEY, F.lit("risk").alias("kind"), F.col("node_id").alias("id"), "score")
    out = head
    for part in (listed, comp, scores):
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*[f.split(" ")[0] for f in BASELINE_LINE.split(", ")])


def write_baseline(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """Baseline lines; None when there is no baseline yet."""
    return spark.read.schema(BASELINE_LINE).json(path) if _exists(spark, path) else None


DOCUMENT = (
    "project_id string, fileCount bigint, edgeCount bigint, "
    "cycles array<struct<id:string,chain:array<string>>>, cyclesTruncated boolean, "
    "cycleComponents array<array<string>>, risk map<string,int>"
)


def read_baseline_documents(spark: SparkSession, path: str) -> DataFrame:
    """Baselines kept as one JSON document per project (with its project_id), as lines.

    Older documents lack the cycle fields: they give no component rows.
    """
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    head = docs.select(
        KEY, F.lit("totals").alias("kind"), F.col("fileCount").alias("file_count"),
        F.col("edgeCount").alias("edge_count"), F.coalesce("cyclesTruncated", F.lit(False)).alias("truncated"),
    )
    cycles = docs.select(KEY, F.explode("cycles").alias("c")).select(
        KEY, F.lit("cycle").alias("kind"), F.col("c.id").alias("id"), F.col("c.chain").alias("members")
    )
    comp = docs.select(KEY, F.explode("cycleComponents").alias("c")).select(
        KEY, F.array_min("c").alias("id"), F.explode("c").alias("n")
    ).select(KEY, F.lit("component").alias("kind"), "id", F.array("n").alias("members"))
    risk = docs.select(KEY, F.explode("risk").alias("id", "score")).withColumn("kind", F.lit("risk"))
    out = head
    for part in (cycles, comp, risk):
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*[f.split(" ")[0] for f in BASELINE_LINE.split(", ")])


def baseline_cycles(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("kind") == "cycle").select(
        KEY, F.col("id").alias("cycle_id"), (F.size("members") - 1).alias("len"), F.col("members").alias("chain")
    )


def baseline_components(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("kind") == "component").select(
        KEY, F.col("id").alias("component_id"), F.col("members")[0].alias("node_id")
    )


# --- node-link ---------------------------------------------------------------
NODE_LINK = (
    "id string, name string, language string, linesOfCode int, "
    "source string, target string, type string, symbols array<string>"
)


def to_node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, kind, json): one line per node and per link, never a whole graph in one value."""
    n = nodes.select(KEY, F.lit("node").alias("kind"), F.to_json(F.struct(
        F.col("node_id").alias("id"), "name", "language", F.col("lines_of_code").alias("linesOfCode")
    )).alias("json"))
    e = edges.select(KEY, F.lit("link").alias("kind"), F.to_json(
        F.struct("source", "target", "type", "symbols")
    ).alias("json"))
    return n.unionByName(e)


def from_node_link(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) back from node-link rows."""
    parsed = rows.select(KEY, "kind", F.from_json("json", NODE_LINK).alias("j"))
    nodes = parsed.where(F.col("kind") == "node").select(
        KEY, F.col("j.id").alias("node_id"), "j.name", "j.language", F.col("j.linesOfCode").alias("lines_of_code")
    )
    edges = parsed.where(F.col("kind") == "link").select(KEY, "j.source", "j.target", "j.type", "j.symbols")
    return nodes, edges
