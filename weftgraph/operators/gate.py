"""Baseline diff, threshold gate, verdict and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.session import spread

KEY = "project_id"


def cycle_keys(cycles: DataFrame) -> DataFrame:
    """(project_id, members): each cycle as its node set, whatever the rotation."""
    members = F.array_sort(F.array_distinct(F.slice("chain", F.lit(1), F.size("chain") - 1)))
    return cycles.select(KEY, members.alias("members")).distinct()


def new_cycles(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Node sets of listed cycles the baseline does not list."""
    return cycle_keys(current).join(cycle_keys(baseline), [KEY, "members"], "left_anti")


def new_components(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(project_id, component_id, size) of components in no baseline component.

    Baseline components are disjoint, so a component is inside one iff all of
    its nodes carry the same baseline id: an equi-join on nodes, no pairs.
    """
    old = baseline.select(KEY, "node_id", F.col("component_id").alias("old"))
    per = spread(current, old, [KEY, "node_id"], "left").groupBy(KEY, "component_id").agg(
        F.count(F.lit(1)).alias("size"), F.count("old").alias("matched"),
        F.min("old").alias("lo"), F.max("old").alias("hi"),
    )
    inside = (F.col("matched") == F.col("size")) & (F.col("lo") == F.col("hi"))
    return per.where(~inside).select(KEY, "component_id", "size")


def new_tangles(
    cycles: DataFrame, scc: DataFrame, truncated: DataFrame,
    base_cycles: DataFrame, base_scc: DataFrame, base_truncated: DataFrame,
) -> DataFrame:
    """(project_id, members): new cycles, or new components where a listing was cut short.

    ``truncated`` tables hold (project_id, truncated).
    """
    cut_short = (
        truncated.where("truncated").select(KEY).unionByName(base_truncated.where("truncated").select(KEY))
        .distinct()
    )
    by_cycle = new_cycles(cycles, base_cycles).join(cut_short, KEY, "left_anti")
    grown = new_components(scc, base_scc).join(cut_short, KEY, "left_semi")
    by_component = scc.join(grown, [KEY, "component_id"], "left_semi").groupBy(KEY, "component_id").agg(
        F.array_sort(F.collect_list("node_id")).alias("members")
    ).select(KEY, "members")
    return by_cycle.unionByName(by_component)


def verdict(projects: DataFrame, tangles: DataFrame, offenders: DataFrame) -> DataFrame:
    """(project_id, new_cycles, high_risk_files, passed) for every project."""
    count = lambda df, name: df.groupBy(KEY).agg(F.count(F.lit(1)).alias(name))
    out = projects.select(KEY).distinct()
    for df, name in ((tangles, "new_cycles"), (offenders, "high_risk_files")):
        out = out.join(count(df, name), KEY, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("passed", (F.col("new_cycles") == 0) & (F.col("high_risk_files") == 0))


def report(
    totals: DataFrame, verdicts: DataFrame, tangles: DataFrame, offenders: DataFrame,
    style: str = "text", threshold: int | None = None, check_cycles: bool = True,
) -> DataFrame:
    """(project_id, section, sort_score, sort_text, line): report lines of every project.

    Lines are rows, ordered by the sort columns, so a project with very many
    offenders never has to fit in one value. ``totals`` needs file_count,
    edge_count, cycle_count and truncated.
    """
    head = totals.join(verdicts, KEY)
    none = F.lit(0)
    row = lambda df, section, line, score=none, key=F.lit(""): df.select(
        KEY, F.lit(section).alias("section"), score.cast("int").alias("sort_score"),
        key.alias("sort_text"), line.alias("line"),
    )
    label = F.concat(F.col("cycle_count").cast("string"), F.when(F.col("truncated"), "+").otherwise(""))
    shape = lambda f: F.transform("members", f)
    joined_key = F.array_join("members", "\n")
    blocks = []
    if style == "json":
        summary = F.to_json(F.struct(
            "passed", F.col("file_count").alias("fileCount"), F.col("edge_count").alias("edgeCount"),
            F.col("cycle_count").alias("cycleCount"), F.col("truncated").alias("cyclesTruncated"),
            F.col("new_cycles").alias("newCycleCount"), F.col("high_risk_files").alias("highRiskFileCount"),
        ))
        blocks.append(row(head, 0, summary))
        if check_cycles:
            blocks.append(row(tangles, 1, F.to_json(F.struct(F.col("members").alias("newCycle"))), key=joined_key))
        if threshold is not None:
            item = F.to_json(F.struct(F.col("node_id").alias("file"), "score"))
            blocks.append(row(offenders, 2, item, -F.col("score"), F.col("node_id")))
    else:
        md = style == "markdown"
        name = text.code_span if md else text.plain
        first = (
            F.format_string("**%d files &middot; %d dependencies &middot; %s circular dependencies**", "file_count", "edge_count", label)
            if md else
            F.format_string("Analysis: %d files, %d dependencies, %s circular dependencies", "file_count", "edge_count", label)
        )
        blocks.append(row(head, 0, first))
        if check_cycles:
            some = F.format_string(
                "#### New circular dependency introduced (%d)" if md
                else "NEW circular dependencies introduced (%d):", "new_cycles")
            blocks.append(row(head, 1, F.when(F.col("new_cycles") > 0, some).otherwise("No new circular dependencies.")))
            glue, lead = (" &harr; ", "- ") if md else (" <-> ", "  - ")
            blocks.append(row(tangles, 2, F.concat(F.lit(lead), F.array_join(shape(lambda c: name(c)), glue)), key=joined_key))
        if threshold is not None:
            some = F.lit(f"#### Files at or above risk threshold ({threshold})" if md
                         else f"Files at or above risk threshold {threshold}:")
            blocks.append(row(head, 3, F.when(F.col("high_risk_files") > 0, some).otherwise(
                f"No files at or above risk threshold {threshold}.")))
            item = (
                F.concat(F.lit("| "), name(F.col("node_id"), table_cell=True), F.lit(" | "), F.col("score").cast("string"), F.lit(" |"))
                if md else F.concat(F.lit("  - "), name(F.col("node_id")), F.lit(": "), F.col("score").cast("string"), F.lit("/100"))
            )
            if md:
                table = head.where(F.col("high_risk_files") > 0)
                blocks.append(row(table, 4, F.lit("| File | Risk |"), F.lit(-1001)))
                blocks.append(row(table, 4, F.lit("|---|---|"), F.lit(-1000)))
            blocks.append(row(offenders, 4, item, -F.col("score"), F.col("node_id")))
        word = F.when(F.col("passed"), "PASSED").otherwise("FAILED")
        blocks.append(row(head, 5, F.concat(F.lit("**Result: "), word, F.lit("**")) if md else word))
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out
