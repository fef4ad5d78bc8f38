"""Registered queries: every operator over whole corpora derived from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import architecture, paths, risk, text
from weftgraph.operators import (
    alias, components, cycles, extract, facets, gate, graph, history, layering, manifest, metrics,
    packs, reach, scan, throttle, tour,
)
from weftgraph.plans import pipeline
from weftgraph.session import cut, scratch_path
from weftgraph.sources import corpus, snapshots

KEY = "project_id"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(column: str, sep: str = ",") -> F.Column:
    return F.array_join(column, sep).alias(column)


def _build(spark, d, ranges, style="plain"):
    aliased = style == "aliased"
    return pipeline.build(
        corpus.files(spark, d, ranges, style), corpus.known(spark, d, aliased), with_aliases=aliased
    )


def _graph(spark, d, ranges):
    nodes, edges = corpus.graph(spark, d, ranges)
    return nodes, cut(edges)


def _scc(spark, d, ranges):
    nodes, edges = _graph(spark, d, ranges)
    return nodes, edges, components.strong_components(edges)


def _wide(spark, d, ranges=corpus.CLEAN):
    nodes, edges, scc = _scc(spark, d, ranges)
    return metrics.node_table(nodes, edges, scc), edges, scc


def _flat_wide(wide, *more):
    return wide.select(
        KEY, "node_id", "lines_of_code", "in_degree", "out_degree",
        F.round("degree_centrality", 6).alias("degree_centrality"), "in_cycle", "category", "score", "level",
        _joined("reasons", "; "), *more,
    )


# --- scan --------------------------------------------------------------------

@query
def scan_status(spark, d):
    return scan.scan(corpus.messy_files(spark, d)).select(KEY, "path", "scan_status")


@query
def scan_status_counts(spark, d):
    return scan.scan(corpus.messy_files(spark, d)).groupBy(KEY, "scan_status").agg(
        F.count(F.lit(1)).alias("files")
    )


@query
def project_ceiling(spark, d):
    """The ceiling is the mean size of the corpus's projects."""
    listing = corpus.messy_files(spark, d)
    sizes = scan.kept(listing).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    ceiling = int(sizes.agg(F.floor(F.avg("n")).alias("n")).first().n)
    admitted = scan.kept(scan.admit_projects(listing, ceiling)).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("kept_files"), F.lit("admitted").alias("status")
    )
    rejected = scan.rejected_projects(listing, ceiling).withColumn("status", F.lit("rejected"))
    return admitted.unionByName(rejected)


@query
def node_ids(spark, d):
    key = F.col("p_partkey").cast("string")
    root = F.concat(F.lit("C:\\work\\"), F.col("p_brand"))
    full = F.concat(root, F.lit("\\src\\m"), key, F.lit(".js"))
    return corpus.table(spark, d, "part").select(
        F.col("p_brand").alias(KEY), F.col("p_partkey").alias("p"), paths.node_id(full, root).alias("node_id")
    )


@query
def config_files(spark, d):
    k, p = F.col("p_partkey") % 7, F.col("p_partkey").cast("string")
    lit = F.lit
    name = (
        F.when(k == 0, "tsconfig.json").when(k == 1, "TSConfig.App.json").when(k == 2, "jsconfig.json")
        .when(k == 3, "vite.config.mts").when(k == 4, "vite.config.json").when(k == 5, "tsconfig.yaml")
        .otherwise("package.json")
    )
    folder = F.when(F.col("p_partkey") % 5 == 0, F.concat(lit("node_modules/p"), p)).otherwise(F.concat(lit("pkg"), p))
    listing = corpus.table(spark, d, "part").select(
        F.col("p_brand").alias(KEY), F.concat(folder, lit("/"), name).alias("path")
    )
    return scan.config_files(listing)


@query
def repo_addresses(spark, d):
    k, n = F.col("c_custkey") % 12, F.col("c_custkey").cast("string")
    text_of = lambda *bits: F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])
    host = "https://github.com/"
    url = (
        F.when(k == 0, text_of(host, "owner", n, "/repo.js")).when(k == 1, text_of(" ", host, "o", n, "/my_repo.git "))
        .when(k == 2, text_of(host, "o/r", n, "/tree/release/v1.2.3")).when(k == 3, text_of(host, "../user", n))
        .when(k == 4, text_of(host, "o", n, "/..")).when(k == 5, text_of(host, "o", n, "/r/tree/main/../../x"))
        .when(k == 6, text_of(host, "o", n, "/r/tree/a//b")).when(k == 7, text_of(host, "o", n, "/r/tree/-flag"))
        .when(k == 8, text_of(host, "-bad", n, "/r")).when(k == 9, text_of("https://github.com.evil.com/o", n, "/r"))
        .when(k == 10, text_of(host, "o", n, "/r.lock")).otherwise(text_of("http://github.com/o", n, "/r/"))
    )
    return corpus.table(spark, d, "customer").select("c_custkey", manifest.repo_address(url).alias("a")).select(
        "c_custkey", "a.*"
    )


def _admission(spark, d):
    """Budgets a little over the mean archive, whatever the scale."""
    listing = corpus.manifest(spark, d)
    wanted = manifest.wanted_member(F.col("name"), F.col("type")) & (F.col("size") <= manifest.MAX_MEMBER_BYTES)
    sums = listing.groupBy("archive").agg(
        F.count(F.lit(1)).alias("e"), F.sum("size").alias("u"), F.count_if(wanted).alias("t"))
    mean = sums.agg(*[F.floor(F.avg(c) * 1.005).alias(c) for c in ("e", "u", "t")]).first()
    return manifest.admit(listing, max_entries=int(mean.e), max_unpacked=int(mean.u), max_wanted=int(mean.t))


@query
def manifest_rejected(spark, d):
    return _admission(spark, d)[1]


@query
def manifest_wanted(spark, d):
    return _admission(spark, d)[0].select("archive", "seq", "name")


@query
def manifest_running(spark, d):
    sums = {"entries": F.lit(1).cast("bigint"), "unpacked": F.col("size")}
    return manifest.running(corpus.manifest(spark, d), ["archive"], "seq", sums).select(
        "archive", "seq", "entries", "unpacked"
    )


# --- extraction and resolution -----------------------------------------------

@query
def loc_by_file(spark, d):
    files = corpus.files(spark, d, corpus.CLEAN)
    lang = scan.language(F.col("path"))
    return files.select(KEY, "path", extract.lines_of_code(F.col("content"), lang).alias("lines_of_code"))


@query
def language_split(spark, d):
    parsed = _build(spark, d, corpus.CLEAN).parsed
    return parsed.groupBy(KEY, "language").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.size("imports")).alias("imports")
    )


@query
def import_records(spark, d):
    """All import forms of both languages, in source order."""
    rows = extract.imports(_build(spark, d, corpus.CLEAN, "varied").parsed)
    return rows.select(KEY, "path", "ordinal", "language", "specifier", "level", "type", _joined("symbols"))


@query
def parse_errors(spark, d):
    """Every 17th file's broken import line is cut off in the middle, or opens a brace that nothing closes."""
    files = corpus.files(spark, d, corpus.CLEAN)
    cut_off = F.regexp_replace("content", r"(from \.missing\d+ import) x", "$1 (")
    opened = F.regexp_replace(cut_off, r"import x (from '\./missing)", "import { x $1")
    return extract.parse_errors(extract.parse(scan.kept(files.withColumn("content", opened)))).select(
        KEY, "file", F.substring_index("error", ":", 2).alias("error")
    )


@query
def top_dependents(spark, d):
    """Flagship: text in, most depended-on files out."""
    built = _build(spark, d, corpus.CLEAN)
    degree = built.edges.groupBy(KEY, F.col("target").alias("node_id")).agg(
        F.count(F.lit(1)).cast("int").alias("in_degree")
    )
    return facets.top_dependents(degree)


def _edge_rows(edges):
    return edges.select(KEY, "source", "target", "type", _joined("symbols"))


@query
def edges_clean(spark, d):
    return _edge_rows(_build(spark, d, corpus.CLEAN).edges)


@query
def edges_tangled(spark, d):
    return _edge_rows(_build(spark, d, corpus.TANGLED).edges)


@query
def edges_varied(spark, d):
    return _edge_rows(_build(spark, d, corpus.CLEAN, "varied").edges)


@query
def edges_aliased(spark, d):
    return _edge_rows(_build(spark, d, corpus.CLEAN, "aliased").edges)


@query
def import_targets(spark, d):
    """What every import of a corpus of competing rules and files resolves to."""
    return pipeline.build(corpus.crossroads(spark, d)).resolved.select(KEY, "path", "specifier", "target", "kind")


@query
def alias_rules(spark, d):
    return alias.rules(corpus.configs(spark, d)).select(
        KEY, "dir", "rule_rank", "mode", "prefix", "suffix", "wildcard", _joined("targets"), "is_local"
    )


@query
def edges_merged(spark, d):
    """Several imports of one target: first type wins, symbols are united in order."""
    base = corpus.parts(spark, d)
    w = corpus.table(spark, d, "lineitem").join(
        base.select(F.col("p").alias("l_partkey"), KEY), "l_partkey"
    )
    sym = lambda c: F.concat(F.lit("s"), c.cast("string"))
    resolved = w.select(
        KEY, F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit(".js")).alias("path"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 3).cast("string"), F.lit(".js")).alias("target"),
        F.lit("local").alias("kind"),
        F.struct(
            F.lit(0).alias("late"),
            (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).alias("ordinal"),
        ).alias("merge_order"),
        F.when(F.col("l_returnflag") == "A", "import").when(F.col("l_returnflag") == "N", "require").otherwise("re-export").alias("type"),
        F.array(sym(F.col("l_linenumber")), sym(F.col("l_suppkey") % 4), sym(F.col("l_suppkey") % 4)).alias("symbols"),
    )
    return _edge_rows(graph.edges(resolved))


@query
def external_counts(spark, d):
    return _build(spark, d, corpus.CLEAN).external_deps


@query
def unresolved_list(spark, d):
    return _build(spark, d, corpus.CLEAN).unresolved


@query
def cross_language(spark, d):
    return graph.cross_language(_build(spark, d, corpus.TANGLED, "varied").edges).agg(
        F.count(F.lit(1)).alias("violations")
    )


@query
def node_set(spark, d):
    return _build(spark, d, corpus.CLEAN).nodes


# --- metrics -----------------------------------------------------------------

@query
def degree_metrics(spark, d):
    nodes, edges = _graph(spark, d, corpus.TANGLED)
    out = metrics.degree_centrality(metrics.degrees(nodes, edges))
    return out.select(KEY, "node_id", "in_degree", "out_degree", F.round("degree_centrality", 6).alias("degree_centrality"))


@query
def betweenness(spark, d):
    nodes, edges = _graph(spark, d, corpus.CLEAN)
    return metrics.betweenness(nodes, edges, whole=packs.EDGES_IN_TASK).select(KEY, "node_id", F.round("betweenness", 6).alias("betweenness"))


@query
def betweenness_skipped(spark, d):
    """All projects as one: above the node limit the value is NULL."""
    nodes, edges = _graph(spark, d, corpus.CLEAN)
    one = F.lit("ALL").alias(KEY)
    whole = metrics.betweenness(
        nodes.select(one, "node_id"), edges.select(one, "source", "target"), limit=100
    )
    return whole.groupBy(KEY).agg(F.count(F.lit(1)).alias("files"), F.count("betweenness").alias("with_value"))


@query
def dependency_depth(spark, d):
    nodes, edges, scc = _scc(spark, d, corpus.CLEAN)
    return components.dependency_depth(nodes, edges, scc)


@query
def weak_components(spark, d):
    nodes, edges = _graph(spark, d, corpus.CLEAN)
    return components.weak_components(nodes, edges)


@query
def graph_totals(spark, d):
    nodes, edges = _graph(spark, d, corpus.KNOTTED)
    out = metrics.graph_totals(nodes, edges, components.weak_components(nodes, edges))
    return out.withColumn("avg_raw", F.round("avg_raw", 6))


@query
def node_table(spark, d):
    return _flat_wide(_wide(spark, d)[0])


@query
def node_table_full(spark, d):
    """The wide row with dependency depth and betweenness."""
    nodes, edges, scc = _scc(spark, d, corpus.CLEAN)
    wide = metrics.node_table(
        nodes, edges, scc, depth=components.dependency_depth(nodes, edges, scc), betweenness=metrics.betweenness(nodes, edges, whole=packs.EDGES_IN_TASK))
    return _flat_wide(wide, "depth", F.round("betweenness", 6).alias("betweenness"))


# --- cycles and reach --------------------------------------------------------

@query
def scc_members(spark, d):
    return _scc(spark, d, corpus.KNOTTED)[2]


@query
def scc_sizes(spark, d):
    return components.component_summary(_scc(spark, d, corpus.TANGLED)[2])


@query
def nodes_in_cycles(spark, d):
    nodes, _, scc = _scc(spark, d, corpus.TANGLED)
    return nodes.join(scc.select(KEY, "node_id"), [KEY, "node_id"], "left_semi").select(KEY, "node_id")


def _listed(spark, d, ranges):
    _, edges, scc = _scc(spark, d, ranges)
    found = cut(cycles.all_cycles(edges, scc, whole=packs.EDGES_IN_TASK))
    return cycles.listed_cycles(found), cycles.truncated_projects(found), scc


@query
def cycles_clean(spark, d):
    return _listed(spark, d, corpus.CLEAN)[0].select(KEY, "cycle_id", "len", _joined("chain", " > "))


@query
def cycles_capped(spark, d):
    return _listed(spark, d, corpus.KNOTTED)[0].select(KEY, "cycle_id", "len", _joined("chain", " > "))


@query
def cycle_truncation(spark, d):
    return _listed(spark, d, corpus.KNOTTED)[1]


@query
def nodes_in_listed_cycles(spark, d):
    return cycles.nodes_in_listed(_listed(spark, d, corpus.CLEAN)[0])


@query
def components_of_cycles(spark, d):
    return cycles.components_of_cycles(_listed(spark, d, corpus.CLEAN)[0])


def _as_files(nodes):
    return nodes.select(KEY, F.col("node_id").alias("file"))


@query
def impact_counts(spark, d):
    nodes, edges = _graph(spark, d, corpus.CLEAN)
    return reach.impact_counts(edges, _as_files(nodes))


@query
def impact_files(spark, d):
    nodes, edges = _graph(spark, d, corpus.CLEAN)
    return reach.impact(edges, _as_files(nodes), whole=packs.EDGES_IN_TASK)


@query
def change_impact(spark, d):
    """A change set of every tenth part's file: what it affects, and over how many imports."""
    nodes, edges = _graph(spark, d, corpus.CLEAN)
    number = F.regexp_extract("node_id", r"m(\d+)\.", 1).cast("bigint")
    return reach.change_impact(edges, _as_files(nodes.where(number % 10 == 0)))


@query
def file_dependencies(spark, d):
    return reach.dependencies(_graph(spark, d, corpus.CLEAN)[1])


@query
def file_dependents(spark, d):
    return reach.dependents(_graph(spark, d, corpus.CLEAN)[1])


@query
def khop2(spark, d):
    nodes, edges = _graph(spark, d, corpus.CLEAN)
    return reach.neighbourhood(edges, nodes.select(KEY, F.col("node_id").alias("root")), 2)


@query
def khop_clamped(spark, d):
    nodes, edges = _graph(spark, d, corpus.CLEAN)
    found = reach.neighbourhood(edges, nodes.select(KEY, F.col("node_id").alias("root")), 9, most=reach.MAX_HOPS, whole=packs.EDGES_IN_TASK)
    return found.groupBy(KEY, "root").agg(F.count(F.lit(1)).alias("reached"))


@query
def focus_start(spark, d):
    return facets.focus_start(_wide(spark, d)[0])


@query
def induced_subgraph(spark, d):
    nodes, edges = _graph(spark, d, corpus.TANGLED)
    keep = nodes.where(F.col("lines_of_code") >= 200)
    return graph.induced(edges, keep).select(KEY, "source", "target")


@query
def cycle_edges(spark, d):
    _, edges, scc = _scc(spark, d, corpus.KNOTTED)
    return cycles.cycle_edge_flags(edges, scc).select(KEY, "source", "target", "in_cycle")


@query
def feedback_edges(spark, d):
    _, edges, scc = _scc(spark, d, corpus.KNOTTED)
    return layering.feedback_edges(edges, scc, whole=packs.EDGES_IN_TASK)


@query
def isolated_files(spark, d):
    return facets.isolated(*_graph(spark, d, corpus.CLEAN)).select(KEY, "node_id", "isolated")


# --- scoring and listings ----------------------------------------------------

@query
def architecture_histogram(spark, d):
    nodes, _ = corpus.graph(spark, d, corpus.CLEAN)
    return facets.category_histogram(nodes.withColumn("category", architecture.category(F.col("node_id"))))


@query
def architecture_of_messy(spark, d):
    return corpus.messy_files(spark, d).select(KEY, "path", architecture.category(F.col("path")).alias("category"))


@query
def risk_scores(spark, d):
    return _wide(spark, d, corpus.TANGLED)[0].select(KEY, "node_id", "score", "level", _joined("reasons", "; "))


@query
def risk_levels(spark, d):
    return _wide(spark, d, corpus.TANGLED)[0].groupBy(KEY, "level").agg(F.count(F.lit(1)).alias("files"))


@query
def high_risk_gate(spark, d):
    return risk.at_or_above(_wide(spark, d, corpus.TANGLED)[0], 50).select(KEY, "node_id", "score")


@query
def project_summary(spark, d):
    built = _build(spark, d, corpus.CLEAN)
    edges, nodes = cut(built.edges), built.nodes
    scc = components.strong_components(edges)
    wide = metrics.node_table(nodes, edges, scc)
    listed = cycles.listed_cycles(cut(cycles.all_cycles(edges, scc, whole=packs.EDGES_IN_TASK)))
    return facets.project_summary(wide, edges, listed, built.external_deps, built.unresolved)


@query
def facet_values(spark, d):
    nodes, _ = corpus.graph(spark, d, corpus.CLEAN)
    return facets.facets(nodes.withColumn("category", architecture.category(F.col("node_id"))))


@query
def facet_filter(spark, d):
    wide = _wide(spark, d, corpus.TANGLED)[0]
    return facets.facet_filter(wide, ["Service", "Util", "Model"], "Medium", "src").select(KEY, "node_id")


@query
def file_search(spark, d):
    return facets.search(corpus.graph(spark, d, corpus.CLEAN)[0], " Utils/M1 ").select(KEY, "node_id")


@query
def folder_tree(spark, d):
    return facets.folder_tree(corpus.graph(spark, d, corpus.CLEAN)[0])


@query
def imports_panel(spark, d):
    return facets.imports_panel(_graph(spark, d, corpus.CLEAN)[1]).select(
        KEY, "file", "direction", "other", "type", _joined("symbols")
    )


# --- snapshots, gate, text ---------------------------------------------------

@query
def snapshot_read(spark, d):
    """Two analyses stored, one read back."""
    path = scratch_path(spark, "snapshots")
    for name, ranges in (("clean", corpus.CLEAN), ("knotted", corpus.KNOTTED)):
        nodes, edges = corpus.graph(spark, d, ranges)
        snapshots.write_snapshot({"nodes": nodes, "edges": edges}, path, name)
    return _edge_rows(snapshots.read_snapshot(spark, path, "edges", "knotted"))


@query
def snapshot_evolution(spark, d):
    """Rows written before and after two columns were added, under one schema."""
    path = scratch_path(spark, "evolved")
    nodes, _ = corpus.graph(spark, d, corpus.CLEAN)
    old = nodes.where(F.col("language") == "python").select(KEY, "node_id")
    new = nodes.where(F.col("language") != "python").select(
        KEY, "node_id", "lines_of_code", F.lit(True).alias("truncated")
    )
    old.write.mode("append").parquet(path)
    new.write.mode("append").parquet(path)
    return snapshots.read_evolved(spark, path, new.schema, {"lines_of_code": 0, "truncated": False})


def _baseline(spark, d, ranges):
    nodes, edges, scc = _scc(spark, d, ranges)
    found = cut(cycles.all_cycles(edges, scc, whole=packs.EDGES_IN_TASK))
    totals = nodes.groupBy(KEY).agg(F.count(F.lit(1)).alias("file_count")).join(
        edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("edge_count")), KEY, "left"
    ).join(cycles.truncated_projects(found), KEY, "left").select(
        KEY, "file_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"),
        F.coalesce("listed", F.lit(0)).alias("cycle_count"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )
    wide = metrics.node_table(nodes, edges, scc)
    return totals, cycles.listed_cycles(found), scc, wide


@query
def baseline_roundtrip(spark, d):
    path = scratch_path(spark, "baseline")
    totals, listed, scc, wide = _baseline(spark, d, corpus.CLEAN)
    snapshots.write_baseline(snapshots.baseline_lines(totals, listed, scc, wide), path)
    lines = snapshots.read_baseline(spark, path)
    return lines.select(KEY, "kind", "id", "file_count", "edge_count", "truncated", "score", _joined("members", " > "))


@query
def node_link_rows(spark, d):
    return snapshots.to_node_link(*corpus.graph(spark, d, corpus.CLEAN))


@query
def node_link_roundtrip(spark, d):
    nodes, edges = snapshots.from_node_link(snapshots.to_node_link(*corpus.graph(spark, d, corpus.CLEAN)))
    return _edge_rows(edges)


@query
def new_cycles(spark, d):
    now, _, _ = _listed(spark, d, corpus.KNOTTED)
    before, _, _ = _listed(spark, d, corpus.CLEAN)
    return gate.new_cycles(now, before).select(KEY, _joined("members", " > "))


@query
def new_components(spark, d):
    return gate.new_components(_scc(spark, d, corpus.KNOTTED)[2], _scc(spark, d, corpus.CLEAN)[2])


def _gate(spark, d):
    totals, listed, scc, wide = _baseline(spark, d, corpus.KNOTTED)
    base_listed, base_cut, base_scc = _listed(spark, d, corpus.CLEAN)
    tangles = cut(gate.new_tangles(listed, scc, totals, base_listed, base_scc, base_cut))
    offenders = cut(risk.at_or_above(wide, 50).select(KEY, "node_id", "score"))
    return totals, tangles, offenders, gate.verdict(totals, tangles, offenders)


@query
def verdict(spark, d):
    return _gate(spark, d)[3]


def _report(spark, d, style):
    totals, tangles, offenders, verdicts = _gate(spark, d)
    return gate.report(totals, verdicts, tangles, offenders, style, threshold=50).select(
        KEY, "section", "sort_score", "line"
    )


@query
def report_text(spark, d):
    return _report(spark, d, "text")


@query
def report_markdown(spark, d):
    return _report(spark, d, "markdown")


@query
def report_json(spark, d):
    return _report(spark, d, "json")


@query
def clean_fields(spark, d):
    return corpus.table(spark, d, "documents").select("doc_id", text.clean_field(F.col("text")).alias("cleaned"))


@query
def plain_text(spark, d):
    return corpus.table(spark, d, "pages").select("page_id", text.plain(F.col("html")).alias("plain"))


@query
def code_spans(spark, d):
    messy = F.concat(
        F.repeat(F.lit("`"), (F.col("page_id") % 4).cast("int")), F.col("url"), F.lit("|a``b\n")
    )
    return corpus.table(spark, d, "pages").select(
        "page_id", text.code_span(messy).alias("span"), text.code_span(messy, table_cell=True).alias("cell")
    )


# --- history -----------------------------------------------------------------

NOW = "2024-01-30 23:57:30"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query
def retention(spark, d):
    return history.retained(corpus.snapshots(spark, d)).select("snapshot_id", F.col("created_at").cast("string").alias("created_at"))


@query
def retention_cascade(spark, d):
    _, dropped, left = history.retention(corpus.snapshots(spark, d), corpus.cache_writes(spark, d))
    return left.groupBy("cache_key").agg(F.count(F.lit(1)).alias("entries"))


@query
def session_expiry(spark, d):
    now = F.lit("1998-06-30 00:00:00").cast("timestamp_ntz")
    return history.unexpired_sessions(corpus.snapshots(spark, d), now).select("snapshot_id")


@query
def visibility(spark, d):
    viewer = F.lit("7")
    return history.visible(corpus.snapshots(spark, d), viewer).select("snapshot_id")


def _cache(spark, d):
    empty = corpus.cache_writes(spark, d).select("cache_key", "snapshot_id", "cached_at").limit(0)
    return history.cache_upsert(empty, corpus.cache_writes(spark, d), _now())


@query
def cache_upsert(spark, d):
    """Second-half writes over the cache the first half left."""
    writes = corpus.cache_writes(spark, d)
    first = writes.where(F.col("seq") % 2 == 0)
    second = writes.where(F.col("seq") % 2 == 1)
    empty = writes.select("cache_key", "snapshot_id", "cached_at").limit(0)
    old = history.cache_upsert(empty, first, _now())
    now = F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")
    return history.cache_upsert(old, second, now).select(
        "cache_key", "snapshot_id", F.col("cached_at").cast("string").alias("cached_at")
    )


@query
def ttl_lookup(spark, d):
    users = corpus.table(spark, d, "events").select(
        F.explode(F.array(
            F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type"),
            F.concat(F.col("user_id").cast("string"), F.lit(":none")),
        )).alias("cache_key")
    ).distinct()
    return history.cache_lookup(_cache(spark, d), corpus.snapshots(spark, d), users, _now())


@query
def throttle_decisions(spark, d):
    return throttle.decide(corpus.hits(spark, d), limit=2, window_seconds=259_200)


@query
def throttle_by_bucket(spark, d):
    """One client per bucket: few keys with very many hits each."""
    hits = corpus.hits(spark, d).withColumn("client", F.lit("all"))
    return throttle.decide(hits, limit=12, window_seconds=14_400)


# --- guided tour -------------------------------------------------------------

def _stage(spark, d, ranges=corpus.CLEAN):
    wide, edges, scc = _wide(spark, d, ranges)
    return tour.prepare(wide, edges), edges, scc


@query
def tour_roles(spark, d):
    stage, _, _ = _stage(spark, d)
    return stage.files.select(KEY, "node_id", "i", "o", "stage")


@query
def foundation_tour(spark, d):
    stage, edges, scc = _stage(spark, d)
    depth = components.dependency_depth(stage.files, edges, scc)
    return tour.foundation(stage, depth).select(KEY, "stop_no", "node_id", "stage", _joined("reasons", "; "))


@query
def entry_reach(spark, d):
    return tour.entry_reach(_stage(spark, d)[0])


@query
def trace_roots(spark, d):
    return tour.trace_roots(_stage(spark, d)[0]).select(KEY, _joined("roots"))


@query
def trace_tour(spark, d):
    return tour.trace(_stage(spark, d)[0]).select(
        KEY, "stop_no", "node_id", "label", "stage", _joined("reasons", "; "), _joined("members")
    )


@query
def tour_notes(spark, d):
    return tour.notes(_stage(spark, d)[0])


@query
def stage_runs(spark, d):
    stage, edges, scc = _stage(spark, d)
    return tour.stage_runs(tour.foundation(stage, components.dependency_depth(stage.files, edges, scc)))
