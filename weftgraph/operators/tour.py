"""Guided reading orders: foundation (bottom-up) and trace (top-down)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators import graph, metrics
from weftgraph.operators.reach import reach_counts
from weftgraph.session import cut, cut_measure

KEY = "project_id"

# Fixed values the results depend on.
MAX_STOPS = 12
GROUP_MIN = 3
MAX_ROOTS = 3
HUB_MIN_OUT = 3
ENTRY, HUB, CORE, LEAF = "Entry points", "Orchestrators", "Core logic", "Building blocks"
CODE_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py")
NOISE_DIRS = (
    "examples", "example", "docs", "doc", "demo", "demos", "sample", "samples", "benchmarks",
    "benchmark", "fixtures", "e2e", "scripts", "test", "tests", "__tests__", "spec", "specs",
)
NOISE_NAMES = (
    r"(^|/)([^/]*\.config\.(js|cjs|mjs|ts)|conftest\.py|setupTests\.(js|ts)|test_[^/]*\.py"
    r"|[^/]*_test\.py|[^/]*\.(test|spec)\.[jt]sx?)$"
)
LEAF_GROUP_REASON = "Leaf files - none of them import anything else in this project"
NO_LINKS_NOTE = (
    "No import connections were found between these files, so there is no dependency order to tour."
)


def eligible(wide: DataFrame) -> DataFrame:
    """Code files worth a stop; in a project with none, every code file."""
    path = F.col("node_id")
    folders = F.split(F.lower(path), "/")
    noisy = (
        path.rlike(NOISE_NAMES) | (F.col("category") == "Test")
        | F.arrays_overlap(
            F.slice(folders, F.lit(1), F.size(folders) - 1), F.array(*[F.lit(d) for d in NOISE_DIRS])
        )
    )
    code = wide.where(F.lower(paths.extension(path)).isin(*CODE_EXTENSIONS)).withColumn("strict", ~noisy)
    any_strict = code.groupBy(KEY).agg(F.bool_or("strict").alias("any_strict"))
    return code.join(any_strict, KEY).where(F.col("strict") | ~F.col("any_strict")).drop("strict", "any_strict")


def _role(i: Column, o: Column) -> Column:
    return (
        F.when((i == 0) & (o > 0), ENTRY).when(o == 0, LEAF)
        .when((o >= HUB_MIN_OUT) & (o > i), HUB).otherwise(CORE)
    )


@dataclass
class Stage:
    """Eligible files with their degrees and role in the induced graph, and its edges."""

    files: DataFrame
    edges: DataFrame

    @property
    def connected(self) -> DataFrame:
        return self.files.where(F.col("i") + F.col("o") > 0)


def prepare(wide: DataFrame, edges: DataFrame) -> Stage:
    chosen = cut(eligible(wide))
    inner = cut(graph.induced(edges.select(KEY, "source", "target"), chosen))
    degree = metrics.degrees(chosen, inner).select(
        KEY, "node_id", F.col("in_degree").alias("i"), F.col("out_degree").alias("o")
    )
    files = cut(chosen.join(degree, [KEY, "node_id"]).withColumn("stage", _role(F.col("i"), F.col("o"))))
    return Stage(files, inner)


def importance() -> Column:
    """Sort key, smallest first."""
    return F.struct(
        (-(F.col("i") + F.col("o"))).alias("links"), (-F.col("degree_centrality")).alias("central"), "node_id"
    )


def _top(files: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy(importance())
    return files.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def foundation(stage: Stage, depth: DataFrame) -> DataFrame:
    """(project_id, stop_no, node_id, stage, reasons): the most relied-upon files, deepest last."""
    picked = _top(stage.connected, MAX_STOPS).join(depth, [KEY, "node_id"])
    w = Window.partitionBy(KEY).orderBy("depth", "rank")
    return picked.withColumn("stop_no", F.row_number().over(w)).select(
        KEY, "stop_no", "node_id", "stage", reasons(F.lit(None).cast("string")).alias("reasons")
    )


def reasons(parent: Column) -> Column:
    """Why a file is a stop; ``parent`` is the path that led to it, or NULL."""
    i, o = F.col("i"), F.col("o")
    return F.array_compact(F.array(
        F.when(parent.isNotNull(), F.concat(F.lit("Imported by "), paths.basename(parent))),
        F.when(F.col("stage") == ENTRY, "Nothing else in this project imports it - likely where execution starts"),
        F.when(F.col("stage") == HUB, F.format_string("Imports %d files - it wires them together", o)),
        F.when(i > 1, F.format_string("%d other files depend on this", i))
        .when((i == 1) & parent.isNull(), F.format_string("%d other file depends on this", i)),
        F.when(F.col("category") != "Unknown", F.concat(F.lit("Classified as "), "category")),
        F.when(F.col("in_cycle"), "Part of a circular dependency - worth understanding the tangle"),
    ))


def entry_reach(stage: Stage) -> DataFrame:
    """(project_id, root, reach) of every entry point."""
    entries = stage.connected.where(F.col("stage") == ENTRY).select(KEY, F.col("node_id").alias("root"))
    return reach_counts(stage.edges, entries)


def trace_roots(stage: Stage) -> DataFrame:
    """(project_id, roots): up to three entries by reach; else the most important file."""
    files = stage.connected
    ranked = entry_reach(stage).join(
        files.select(KEY, F.col("node_id").alias("root"), "o"), [KEY, "root"]
    )
    w = Window.partitionBy(KEY).orderBy(F.desc("reach"), F.desc("o"), "root")
    best = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MAX_ROOTS)
    roots = best.groupBy(KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "root"))), lambda r: r["root"]).alias("roots")
    )
    busiest = files.groupBy(KEY).agg(F.array(F.min(importance())["node_id"]).alias("busiest"))
    return busiest.join(roots, KEY, "left").select(KEY, F.coalesce("roots", "busiest").alias("roots"))


def trace_walk(stage: Stage, max_stops: int = MAX_STOPS) -> DataFrame:
    """(project_id, stops): the budgeted breadth-first walk, one stop of every project per job.

    State per project is a queue, the visited files and the stops so far; at
    most ``max_stops`` jobs run, whatever the number of projects.
    """
    leaf = stage.files.select(KEY, F.col("node_id").alias("target"), (F.col("o") == 0).alias("leaf"))
    children = cut(
        stage.edges.where(F.col("source") != F.col("target")).join(leaf, [KEY, "target"])
        .groupBy(KEY, F.col("source").alias("cur"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("target").alias("id"), "leaf"))).alias("kids"))
    )
    strings, queue_type = "array<string>", "array<struct<id:string,parent:string>>"
    stop_type = "array<struct<id:string,parent:string,members:array<string>>>"
    state = trace_roots(stage).select(
        KEY, "roots", F.lit(-1).alias("at"), F.lit(0).alias("budget"), F.lit(0).alias("used"),
        F.array().cast(queue_type).alias("queue"), F.array().cast(strings).alias("visited"),
        F.array().cast(stop_type).alias("stops"), F.lit(False).alias("done"),
    )
    while True:
        n_stops = F.size("stops")
        waiting = F.filter("queue", lambda q: ~F.array_contains(F.col("visited"), q["id"]))
        state = state.withColumn("queue", waiting)
        going = (F.size("queue") > 0) & (F.col("used") < F.col("budget")) & (n_stops < max_stops)
        # the next root not seen yet, when this walk has ended
        numbered = F.transform("roots", lambda r, i: F.struct(r.alias("id"), i.alias("i")))
        later = F.filter(
            numbered, lambda r: (r["i"] > F.col("at")) & ~F.array_contains(F.col("visited"), r["id"])
        )
        state = state.withColumns({"going": going, "later": later}).withColumn(
            "done", ~F.col("going") & ((F.size("later") == 0) | (n_stops >= max_stops))
        )
        left = F.lit(max_stops) - n_stops
        root = F.element_at("later", F.when(F.size("later") > 0, F.lit(1)))
        roots_left = F.size("roots") - root["i"]
        share = F.when(roots_left == 1, left).otherwise(
            F.greatest(F.lit(3), F.ceil(left / roots_left).cast("int"))
        )
        first = F.element_at("queue", F.when(F.size("queue") > 0, F.lit(1)))
        state = state.withColumns({
            "cur": F.when(F.col("done"), F.lit(None)).when(F.col("going"), first["id"]).otherwise(root["id"]),
            "par": F.when(F.col("going"), first["parent"]),
            "budget": F.when(F.col("going"), F.col("budget")).otherwise(share),
            "used": F.when(F.col("going"), F.col("used")).otherwise(0) + 1,
            "at": F.when(F.col("going"), F.col("at")).otherwise(root["i"]),
            "rest": F.when(
                F.col("going"), F.slice("queue", F.lit(2), F.greatest(F.size("queue") - 1, F.lit(0)))
            ).otherwise(F.array().cast(queue_type)),
        })
        # only the children of this stop's files are joined to the state, which is one row per project
        met = children.join(state.where("cur IS NOT NULL").select(KEY, "cur"), [KEY, "cur"])
        state = state.join(met, [KEY, "cur"], "left")
        seen = F.array_append("visited", F.col("cur"))
        kids = F.filter(
            F.coalesce("kids", F.array().cast("array<struct<id:string,leaf:boolean>>")),
            lambda k: ~F.array_contains(F.col("seen"), k["id"]),
        )
        state = state.withColumn("seen", F.when(F.col("done"), F.col("visited")).otherwise(seen))
        state = state.withColumn("kids", kids)
        leaves = F.transform(F.filter("kids", lambda k: k["leaf"]), lambda k: k["id"])
        state = state.withColumn("leaves", leaves)
        grouped = (
            (F.size("leaves") >= GROUP_MIN) & (F.col("used") < F.col("budget")) & (F.size("stops") + 1 < max_stops)
        )
        state = state.withColumn("grouped", grouped)
        stop = lambda i, p, m: F.struct(i.alias("id"), p.alias("parent"), m.alias("members"))
        none = F.array().cast(strings)
        one = F.array(stop(F.col("cur"), F.col("par"), none))
        two = F.array(stop(F.col("cur"), F.col("par"), none), stop(F.col("leaves")[0], F.col("cur"), F.col("leaves")))
        queued = F.transform(
            F.filter("kids", lambda k: ~(F.col("grouped") & k["leaf"])),
            lambda k: F.struct(k["id"].alias("id"), F.col("cur").alias("parent")),
        )
        state = state.select(
            KEY, "roots", "at", "budget",
            F.when(F.col("done"), F.col("used")).otherwise(F.col("used") + F.col("grouped").cast("int")).alias("used"),
            F.when(F.col("done"), F.array().cast(queue_type)).otherwise(F.concat("rest", queued)).alias("queue"),
            F.when(F.col("done") | ~F.col("grouped"), F.col("seen"))
            .otherwise(F.concat("seen", "leaves")).alias("visited"),
            F.when(F.col("done"), F.col("stops"))
            .otherwise(F.concat("stops", F.when(F.col("grouped"), two).otherwise(one))).alias("stops"),
            "done",
        )
        state, seen_now = cut_measure(state, active=F.count_if(~F.col("done")))
        if not seen_now["active"]:
            return state


def trace(stage: Stage, max_stops: int = MAX_STOPS) -> DataFrame:
    """(project_id, stop_no, node_id, label, stage, reasons, members) of the top-down tour."""
    state = trace_walk(stage, max_stops)
    walked = state.select(KEY, F.posexplode("stops").alias("pos", "s")).select(
        KEY, (F.col("pos") + 1).alias("stop_no"), F.col("s.id").alias("node_id"),
        F.col("s.parent").alias("parent"), F.col("s.members").alias("members"),
    )
    visited = state.select(KEY, F.explode("visited").alias("node_id"))
    room = state.select(KEY, F.size("stops").alias("n"))
    rest = _top(stage.connected.join(visited, [KEY, "node_id"], "left_anti"), max_stops).join(room, KEY)
    topped = rest.where(F.col("rank") + F.col("n") <= max_stops).select(
        KEY, (F.col("rank") + F.col("n")).alias("stop_no"), "node_id",
        F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("members"),
    )
    info = stage.files.select(KEY, "node_id", "i", "o", "stage", "category", "in_cycle")
    is_group = F.size("members") > 0
    label = F.format_string("%d files used by %s", F.size("members"), paths.basename(F.col("parent")))
    return walked.unionByName(topped).join(info, [KEY, "node_id"]).select(
        KEY, "stop_no", "node_id",
        F.when(is_group, label).otherwise(F.col("node_id")).alias("label"),
        F.when(is_group, LEAF).otherwise(F.col("stage")).alias("stage"),
        F.when(is_group, F.array(F.lit(LEAF_GROUP_REASON))).otherwise(reasons(F.col("parent"))).alias("reasons"),
        "members",
    )


def notes(stage: Stage) -> DataFrame:
    """(project_id, isolated, note): files left out because nothing links them."""
    tail = (
        " no import connections to the rest of the project (standalone scripts, or code that talks "
        "to the rest over HTTP), so can't be placed in this tour."
    )
    alone = F.col("i") + F.col("o") == 0
    counted = stage.files.groupBy(KEY).agg(
        F.count_if(alone).alias("isolated"), F.count_if(~alone).alias("linked")
    )
    note = (
        F.when(F.col("linked") == 0, NO_LINKS_NOTE)
        .when(F.col("isolated") == 1, F.concat(F.lit("1 other file has"), F.lit(tail)))
        .when(F.col("isolated") > 1, F.concat(F.col("isolated").cast("string"), F.lit(" other files have"), F.lit(tail)))
    )
    return counted.select(KEY, "isolated", note.alias("note"))


def stage_runs(stops: DataFrame) -> DataFrame:
    """(project_id, run_no, stage, first_stop, last_stop): consecutive stops of one stage.

    A window group is one tour of at most ``MAX_STOPS`` rows.
    """
    w = Window.partitionBy(KEY).orderBy("stop_no")
    fresh = F.coalesce((F.lag("stage").over(w) != F.col("stage")).cast("int"), F.lit(1))
    return (
        stops.withColumn("fresh", fresh).withColumn("run_no", F.sum("fresh").over(w))
        .groupBy(KEY, "run_no", "stage")
        .agg(F.min("stop_no").alias("first_stop"), F.max("stop_no").alias("last_stop"))
    )
