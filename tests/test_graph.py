import itertools
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.operators import components, condense, cycles, gate, layering, metrics, packs, reach
from weftgraph.session import cut


def bfs(adj, root):
    dist, todo = {root: 0}, deque([root])
    while todo:
        u = todo.popleft()
        for v in adj[u]:
            if v not in dist:
                dist[v] = dist[u] + 1
                todo.append(v)
    return dist


@pytest.fixture(scope="module")
def world(spark):
    """Many small projects at once: 14 random digraphs, a ring, a long chain, loops, K9."""
    rnd, graphs = random.Random(7), {}
    for i in range(14):
        n = rnd.randint(2, 9)
        names = [f"n{k}" for k in range(n)]
        p = rnd.choice([0.1, 0.2, 0.3])
        graphs[f"r{i}"] = (names, {(a, b) for a in names for b in names if rnd.random() < p})
    ring = [f"k{k:02d}" for k in rnd.sample(range(30), 30)]
    graphs["ring"] = (ring, set(zip(ring, ring[1:] + ring[:1])))
    chain = [f"c{k:02d}" for k in rnd.sample(range(25), 25)]
    graphs["chain"] = (chain, set(zip(chain, chain[1:])))
    graphs["loop"] = (["a", "b"], {("a", "a")})
    graphs["none"] = (["x"], set())
    k9 = [f"f{k}.js" for k in range(9)]
    graphs["k9"] = (k9, set(itertools.permutations(k9, 2)))
    nodes = [(p, n, n, "javascript", 10) for p, (ns, _) in graphs.items() for n in ns]
    edges = [(p, a, b, "import", []) for p, (_, es) in graphs.items() for a, b in es]
    return graphs, cut(spark.createDataFrame(nodes, schema.NODES)), cut(spark.createDataFrame(edges, schema.EDGES))


@pytest.fixture(scope="module")
def scc(world):
    return components.strong_components(world[2])


def adjacency(graph):
    out = defaultdict(set)
    for a, b in graph[1]:
        out[a].add(b)
    return out


def true_scc(graph):
    adj = adjacency(graph)
    far = {n: set(bfs(adj, n)) for n in graph[0]}
    groups = {frozenset(m for m in far[n] if n in far[m]) for n in graph[0]}
    return {g for g in groups if len(g) > 1 or (min(g), min(g)) in graph[1]}


def test_strong_components(world, scc):
    got = defaultdict(set)
    for r in scc.collect():
        got[r.project_id, r.component_id].add(r.node_id)
    want = {(p, min(g)): set(g) for p, graph in world[0].items() for g in true_scc(graph)}
    assert dict(got) == want


def test_weak_components(world):
    graphs, nodes, edges = world
    got = {(r.project_id, r.node_id): r.component for r in components.weak_components(nodes, edges).collect()}
    for p, (names, pairs) in graphs.items():
        both = defaultdict(set)
        for a, b in pairs:
            both[a].add(b)
            both[b].add(a)
        assert {n: got[p, n] for n in names} == {n: min(bfs(both, n)) for n in names}


def test_depth(world, scc):
    graphs, nodes, edges = world
    got = {(r.project_id, r.node_id): r.depth for r in components.dependency_depth(nodes, edges, scc).collect()}
    for p, graph in graphs.items():
        home = {n: min(g) for g in true_scc(graph) for n in g}
        adj = defaultdict(set)
        for a, b in graph[1]:
            if home.get(a, a) != home.get(b, b):
                adj[home.get(a, a)].add(home.get(b, b))

        def longest(c):
            return max((1 + longest(x) for x in adj[c]), default=0)

        assert {n: got[p, n] for n in graph[0]} == {n: longest(home.get(n, n)) for n in graph[0]}


def simple_cycles(graph):
    adj, out = adjacency(graph), set()

    def walk(start, path):
        for v in adj[path[-1]]:
            if v == start:
                out.add(tuple(path))
            elif v > start and v not in path:
                walk(start, path + [v])

    for n in graph[0]:
        walk(n, [n])
    return sorted(out, key=lambda c: (len(c), c))


@pytest.mark.parametrize("limit", [200, 5])
def test_cycles_shortest_first(world, scc, limit):
    """Also with another limit than the service has."""
    graphs, _, edges = world
    found = cut(cycles.all_cycles(edges, scc, limit))
    listed = defaultdict(list)
    for r in cycles.listed_cycles(found, limit).orderBy("project_id", F.expr("int(substr(cycle_id, 7))")).collect():
        assert r.cycle_id == f"cycle-{len(listed[r.project_id])}" and r.chain[0] == r.chain[-1]
        listed[r.project_id].append(tuple(r.chain[:-1]))
    cut_short = {r.project_id: r.truncated for r in cycles.truncated_projects(found, limit).collect()}
    for p, graph in graphs.items():
        want = simple_cycles(graph)
        assert listed[p] == want[:limit]
        assert cut_short.get(p, False) == (len(want) > limit)
    assert cut_short["k9"]


def test_betweenness(world):
    graphs, nodes, edges = world
    got = {(r.project_id, r.node_id): r.betweenness for r in metrics.betweenness(nodes, edges).collect()}
    for p, graph in graphs.items():
        adj, n = adjacency(graph), len(graph[0])
        dist = {s: bfs(adj, s) for s in graph[0]}

        def count(s, t, memo={}):
            if s == t:
                return 1
            return sum(count(v, t) for v in adj[s] if dist[s][t] == 1 + dist[v].get(t, 10**9))

        for v in graph[0]:
            raw = sum(
                count(s, v) * count(v, t) / count(s, t)
                for s in graph[0] for t in dist[s]
                if len({s, v, t}) == 3 and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]
            ) if p != "k9" else 0
            assert got[p, v] == pytest.approx(raw / ((n - 1) * (n - 2)) if n > 2 else raw)
    assert all(r.betweenness is None for r in metrics.betweenness(nodes, edges, limit=0).collect())


def test_impact_and_neighbourhood(world):
    graphs, nodes, edges = world
    rows = reach.impact_counts(edges, nodes.select("project_id", F.col("node_id").alias("file"))).collect()
    near = reach.neighbourhood(edges, nodes.select("project_id", F.col("node_id").alias("root")), 2).collect()
    two = defaultdict(set)
    for r in near:
        two[r.project_id, r.root].add(r.node)
    for r in rows:
        names, pairs = graphs[r.project_id]
        back = defaultdict(set)
        for a, b in pairs:
            back[b].add(a)
        dist = bfs(back, r.file)
        assert r.direct == len(back[r.file])
        assert r.indirect == sum(d > 1 for d in dist.values()) and r.total == r.direct + r.indirect
        both = defaultdict(set)
        for a, b in pairs:
            both[a].add(b)
            both[b].add(a)
        assert two[r.project_id, r.file] == {n for n, d in bfs(both, r.file).items() if d <= 2}


def test_feedback_edges_leave_no_cycle(world, scc):
    graphs, _, edges = world
    rows = layering.feedback_edges(edges, scc).collect()
    forward, held = defaultdict(set), defaultdict(int)
    for r in rows:
        if r.is_feedback:
            held[r.project_id] += 1
        else:
            forward[r.project_id].add((r.source, r.target))
    for p, (names, pairs) in graphs.items():
        assert not true_scc((names, forward[p]))
        loops = sum(a == b for a, b in pairs)
        assert held[p] + len(forward[p]) + loops == len(pairs)
    assert held["ring"] == 1 and held["chain"] == 0


def test_small_metrics(make_graph):
    n, e = make_graph(["a", "b", "c"], [("a", "b"), ("b", "c")])
    got = {r.node_id: (r.in_degree, r.out_degree) for r in metrics.degrees(n, e).collect()}
    assert got == {"a": (0, 1), "b": (1, 1), "c": (1, 0)}
    t = metrics.graph_totals(n, e, components.weak_components(n, e)).collect()[0]
    assert (t.file_count, t.edge_count, t.component_count, t.largest_component, t.avg_dependencies) == (3, 2, 1, 3, 0.67)
    n, e = make_graph(["a", "b", "lone"], [("a", "b")])
    assert metrics.graph_totals(n, e, components.weak_components(n, e)).collect()[0].component_count == 2
    n, e = make_graph(["one"], [])
    assert metrics.degree_centrality(metrics.degrees(n, e)).collect()[0].degree_centrality == 1.0


def test_gate_diffs(spark, make_graph):
    names = [f"f{i}.js" for i in range(5)]
    full = list(itertools.permutations(names, 2))

    def scc_of(pairs):
        nodes = sorted({x for p in pairs for x in p})
        return components.strong_components(make_graph(nodes, pairs)[1])

    base = scc_of(full)
    assert gate.new_components(scc_of(full[1:]), base).count() == 0
    grown = full + [("f0.js", "x.js"), ("x.js", "f0.js"), ("y.js", "z.js"), ("z.js", "y.js")]
    assert {(r.component_id, r.size) for r in gate.new_components(scc_of(grown), base).collect()} == {("f0.js", 6), ("y.js", 2)}
    cyc = lambda rows: spark.createDataFrame([("p", c) for c in rows], "project_id string, chain array<string>")
    now = cyc([["b", "c", "a", "b"], ["x", "y", "x"]])
    assert [r.members for r in gate.new_cycles(now, cyc([["a", "b", "c", "a"]])).collect()] == [["x", "y"]]
    rebuilt = cycles.components_of_cycles(cyc([["a", "b", "a"], ["b", "c", "b"]]))
    assert {(r.component_id, r.node_id) for r in rebuilt.collect()} == {("a", "a"), ("a", "b"), ("a", "c")}


def plain_reach(graph):
    adj = adjacency(graph)
    return {n: set(bfs(adj, n)) - {n} for n in graph[0]}


def test_reach_sets(world, scc):
    """Sizes of reach sets, both ways, and the files behind the bits, against a walk from every file."""
    graphs, nodes, edges = world
    graph = condense.condensed(nodes, edges, scc)
    got = {(r.project_id, r.node_id): r.reach for r in condense.reach_sizes(graph).collect()}
    back = {(r.project_id, r.node_id): r.reach for r in condense.reach_sizes(graph.flipped()).collect()}
    sets, numbered = condense.reach_sets(graph)
    at = {(r.b, r.p): r.node_id for r in numbered.selectExpr("bitmap_bucket_number(id) b", "bitmap_bit_position(id) p", "node_id").collect()}
    reached = defaultdict(set)
    for r in sets.collect():
        bits = int.from_bytes(r.bits, "little")
        reached[r.project_id, r.c] |= {at[r.bucket, i] for i in range(bits.bit_length()) if bits >> i & 1}
    home = {(r.project_id, r.node_id): r.c for r in graph.members.collect()}
    for p, g in graphs.items():
        want = plain_reach(g)
        flipped = plain_reach((g[0], {(b, a) for a, b in g[1]}))
        for n in g[0]:
            assert got[p, n] == len(want[n]) and back[p, n] == len(flipped[n])
            assert reached[p, home[p, n]] - {n} == want[n]
    counts = {(r.project_id, r.file): (r.direct, r.indirect, r.total) for r in reach.impact_counts(
        edges, nodes.select("project_id", F.col("node_id").alias("file"))).collect()}
    for p, g in graphs.items():
        flipped = plain_reach((g[0], {(b, a) for a, b in g[1]}))
        for n in g[0]:
            direct = {a for a, b in g[1] if b == n}
            total = flipped[n] | (direct & {n})
            assert counts[p, n] == (len(direct), len(total) - len(direct), len(total))


def test_change_impact(spark, world):
    graphs, nodes, edges = world
    changed = nodes.where("substring(node_id, -1) in ('0', '3', 'a', 'x')").select("project_id", F.col("node_id").alias("file"))
    got = {(r.project_id, r.affected): r.distance for r in reach.change_impact(edges, changed).collect()}
    want = {}
    for p, g in graphs.items():
        adj = adjacency((g[0], {(b, a) for a, b in g[1]}))
        start = [n for n in g[0] if n[-1] in "03ax"]
        for root in start:
            for n, dist in bfs(adj, root).items():
                if n not in start:
                    want[p, n] = min(dist, want.get((p, n), dist))
    assert got == want
    assert reach.change_impact(edges, changed.limit(0)).count() == 0 and reach.change_impact(edges.limit(0), changed).count() == 0


def test_long_chain_in_few_rounds(spark, monkeypatch):
    """A chain of 10,000 files: rounds go by the logarithm of its length."""
    n, rounds = 10_000, []
    measure = condense.cut_measure
    monkeypatch.setattr(condense, "cut_measure", lambda *a, **k: rounds.append(1) or measure(*a, **k))
    line = spark.range(n - 1).selectExpr("'p' project_id", "format_string('c%05d', id) source", "format_string('c%05d', id + 1) target")
    names = spark.range(n).selectExpr("'p' project_id", "format_string('c%05d', id) node_id")
    none = spark.createDataFrame([], "project_id string, component_id string, node_id string")
    rows = components.dependency_depth(names, line, none).collect()
    assert {(r.node_id, r.depth) for r in rows} == {(f"c{i:05d}", n - 1 - i) for i in range(n)}
    assert len(rounds) <= 16


def test_betweenness_in_batches(spark, world, monkeypatch):
    """Batches of roots give the same values, and no batch holds more than its roots times the nodes they can reach."""
    graphs, nodes, edges = world
    value = lambda df: {(r.project_id, r.node_id): round(r.betweenness, 9) for r in df.collect()}
    want = value(metrics.betweenness(nodes, edges))
    batches, paths = [], []
    flows, scratch = metrics._flows, metrics.scratch_path
    monkeypatch.setattr(metrics, "_flows", lambda links, roots: batches.append(roots.count()) or flows(links, roots))
    monkeypatch.setattr(metrics, "scratch_path", lambda s, label: paths.append((label, scratch(s, label))) or paths[-1][1])
    assert value(metrics.betweenness(nodes, edges, batch_rows=600)) == want
    largest = max(len(g[0]) for g in graphs.values())
    held = [spark.read.parquet(f"{path}/*").count() for label, path in paths if label == "levels"]
    assert len(held) == len(batches) > 2 and all(rows <= n * largest for rows, n in zip(held, batches, strict=True))


def test_way_back_grows_as_asked(world, scc, monkeypatch):
    """Distances back are followed no further than the lengths in question and only where cycles are still looked for."""
    _, _, edges = world
    asked = []
    extend = cycles._WayBack.extend
    monkeypatch.setattr(cycles._WayBack, "extend", lambda self, distance, projects: asked.append(distance) or extend(self, distance, projects))
    only = edges.where("project_id = 'k9'")
    found = cycles.listed_cycles(cycles.all_cycles(only, scc, 30), 30)
    assert found.count() == 30 and max(asked) <= 2 + 2 * cycles.AHEAD


def test_paths_and_ways_back_meet(world, scc, monkeypatch):
    """With no room to look ahead, ways back are followed to half of the lengths that are due, and the listing is the same."""
    graphs, _, edges = world
    asked = []
    extend = cycles._WayBack.extend
    monkeypatch.setattr(cycles._WayBack, "extend", lambda self, distance, projects: asked.append(distance) or extend(self, distance, projects))
    monkeypatch.setattr(cycles, "ROUND_ROWS", 0, raising=False)
    found = cycles.listed_cycles(cycles.all_cycles(edges.where("project_id = 'k9'"), scc, 30), 30)
    rows = found.orderBy(F.expr("int(substr(cycle_id, 7))")).collect()
    assert [tuple(r.chain[:-1]) for r in rows] == simple_cycles(graphs["k9"])[:30] and max(asked) <= cycles.AHEAD


def test_repeated_edges_repeat_cycles(make_graph):
    """Every way round is a cycle of its own, as many as the products of equal edges."""
    _, edges = make_graph("abc", [("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")])
    found = cycles.all_cycles(edges, components.strong_components(edges)).collect()
    assert sorted(tuple(r.path) for r in found) == [("a", "b")] * 2 + [("a", "b", "c")] * 2


def test_batches_follow_what_roots_reach(make_graph, monkeypatch):
    """Many short chains in one project: no root reaches far, so few batches do, and small levels compare the roots still under way only."""
    n = 60
    names = [f"{c}{i:03d}" for c in "abc" for i in range(n)]
    nodes, edges = make_graph(names, [(f"{x}{i:03d}", f"{y}{i:03d}") for x, y in ("ab", "bc") for i in range(n)])
    batches, flows = [], metrics._flows
    monkeypatch.setattr(metrics, "_flows", lambda links, roots: batches.append(0) or flows(links, roots))
    monkeypatch.setattr(metrics, "MANY", 0, raising=False)
    monkeypatch.setattr(metrics, "FEW", 2, raising=False)
    got = {r.node_id: r.betweenness for r in metrics.betweenness(nodes, edges, batch_rows=2_000).collect()}
    assert {k for k, v in got.items() if v} == {k for k in names if k[0] == "b"}
    assert abs(got["b000"] - 1 / ((3 * n - 1) * (3 * n - 2))) < 1e-12
    assert len(batches) <= 3  # of 17 if every root reached all


def test_loops_broadcast_nothing(make_graph, monkeypatch):
    """Labels, trimming and way out of components: what grows with the corpus stays on the executors."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def spied(self, *args, **more):
        done = write(self, *args, **more)
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return done

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    names = [f"n{i:02d}" for i in range(12)]
    _, edges = make_graph(names, [*zip(names, names[1:]), ("n03", "n00"), ("n09", "n05"), ("n11", "n11")])
    scc = components.strong_components(edges)
    assert {(r.component_id, r.node_id) for r in scc.collect()} == {
        *(("n00", f"n{i:02d}") for i in range(4)), *(("n05", f"n{i:02d}") for i in range(5, 10)), ("n11", "n11")}
    reach.change_impact(edges, edges.select("project_id", F.lit("n05").alias("file")).distinct()).count()
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]


def test_impact_rows_and_reach_levels(world, spark, monkeypatch):
    """Unpacked rows against a walk from every file; a walk over both ways compares two levels and follows the rows of a level."""
    graphs, nodes, edges = world
    monkeypatch.setattr(reach, "PAIRS", 3, raising=False)
    files = nodes.select("project_id", F.col("node_id").alias("file"))
    got = [(r.project_id, r.file, r.affected, r.is_direct) for r in reach.impact(edges, files).collect()]
    want = set()
    for p, (names, pairs) in graphs.items():
        back = adjacency((names, {(b, a) for a, b in pairs}))
        for file in names:
            want |= {(p, file, n, d == 1) for n, d in bfs(back, file).items() if d}
            want |= {(p, file, file, True)} if (file, file) in pairs else set()
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r.project_id, r.file) for r in reach.impact(edges, files.where("file = 'n1'")).collect()} == {
        w[:2] for w in want if w[1] == "n1"}

    monkeypatch.setattr(reach, "ROWS_IN_TASK", 20, raising=False)
    graphs = {p: g for p, g in graphs.items() if p in ("r1", "r2", "k9", "loop", "none")}
    nodes, edges = (df.where(F.col("project_id").isin(*graphs)) for df in (nodes, edges))
    dealt, repartition = [], type(edges).repartition
    monkeypatch.setattr(type(edges), "repartition", lambda df, n, *keys: dealt.append(n) or repartition(df, n, *keys))
    both = reach.undirected(edges)
    roots = nodes.select("project_id", F.col("node_id").alias("root"))
    far = {(r.project_id, r.root, r.node): r.dist for r in reach.reach(both, roots, both_ways=True).collect()}
    assert far == {(p, root, n): d for p, (names, pairs) in graphs.items() for root in names
                   for n, d in bfs(adjacency((names, pairs | {(b, a) for a, b in pairs})), root).items()}
    assert max(dealt) > 4  # more than the session's own number


def test_corpus_reads_line_items_once(spark, tmp_path):
    from weftgraph.sources import corpus

    spark.createDataFrame([(k, "Brand#11", 3) for k in range(6)], "p_partkey bigint, p_brand string, p_size int").write.parquet(
        str(tmp_path / "part.parquet"))
    spark.createDataFrame([(o, (o + i) % 6, i, 1.0) for o in range(4) for i in range(3)],
                          "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    nodes, edges = corpus.graph(spark, str(tmp_path), corpus.CLEAN)
    for df in (nodes, edges):
        assert not any("lineitem" in f for f in df.inputFiles())
    assert nodes.count() == 6 and edges.count() > 0


def listing(found, limit):
    rows = cycles.listed_cycles(found, limit).orderBy("project_id", F.expr("int(substr(cycle_id, 7))")).collect()
    listed = defaultdict(list)
    for r in rows:
        listed[r.project_id].append(tuple(r.chain[:-1]))
    return listed


@pytest.mark.parametrize(("limit", "held", "in_rounds"), [(200, 8_000_000, False), (5, 8_000_000, False), (5, 100, True), (None, 8_000_000, False)])
def test_cycles_of_a_part_in_one_task(world, scc, monkeypatch, limit, held, in_rounds):
    """Components that a task holds take no rounds; those whose paths are too many for it go through the rounds, and nothing is listed twice."""
    graphs, _, edges = world
    if limit is None:
        edges = edges.where("project_id <> 'k9'")
    calls, rounds = [], cycles._best_first
    monkeypatch.setattr(cycles, "_best_first", lambda *a: calls.append(1) or rounds(*a))
    monkeypatch.setattr(cycles, "HELD", held, raising=False)
    found = cut(cycles.all_cycles(edges, scc, limit, whole=1_000))
    assert bool(calls) == in_rounds
    listed = listing(found, limit or 10**6)
    cut_short = {r.project_id: r.truncated for r in cycles.truncated_projects(found, limit or 10**6).collect()}
    for p, graph in graphs.items():
        want = simple_cycles(graph) if limit or p != "k9" else []
        assert listed[p] == want[:limit] and cut_short.get(p, False) == (limit is not None and len(want) > limit)


def test_large_components_go_in_rounds(world, scc, monkeypatch):
    graphs, _, edges = world
    calls, rounds = [], cycles._best_first
    monkeypatch.setattr(cycles, "_best_first", lambda inner, limit: calls.append({r.project_id for r in inner.collect()}) or rounds(inner, limit))
    listed = listing(cycles.all_cycles(edges.where("project_id in ('k9', 'ring', 'r1', 'loop')"), scc, 30, whole=40), 30)
    assert calls == [{"k9"}] and all(listed[p] == simple_cycles(graphs[p])[:30] for p in ("k9", "ring", "r1", "loop"))


def test_repeated_edges_in_one_task(make_graph):
    _, edges = make_graph("abc", [("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "c")])
    found = cycles.all_cycles(edges, components.strong_components(edges), whole=100).collect()
    assert sorted(tuple(r.path) for r in found) == [("a", "b")] * 2 + [("a", "b", "c")] * 2 + [("c",)]


def test_strong_components_with_and_without_rounds(world, monkeypatch):
    """Projects that a task holds whole take no rounds; larger ones do, and give the same."""
    graphs, _, edges = world
    labels, calls = components._two_way_labels, []
    monkeypatch.setattr(components, "_two_way_labels", lambda *a, **k: calls.append(1) or labels(*a, **k))
    rows = lambda: {(r.project_id, r.component_id, r.node_id) for r in components.strong_components(edges).collect()}
    want = {(p, min(g), n) for p, graph in graphs.items() for g in true_scc(graph) for n in g}
    assert rows() == want and not calls
    for most in (8, 0):
        monkeypatch.setattr(packs, "EDGES_IN_TASK", most)
        assert rows() == want and calls


def test_betweenness_of_parts_in_tasks(world, monkeypatch):
    """Parts that a task holds take no batches, whether one task walks from all files or several share them; larger parts do."""
    _, nodes, edges = world
    value = lambda **more: {(r.project_id, r.node_id): round(r.betweenness, 9) for r in metrics.betweenness(nodes, edges, **more).collect()}
    want = value()
    batched, flows = [], metrics._flows_in_batches
    monkeypatch.setattr(metrics, "_flows_in_batches", lambda named, rows: batched.append({r.project_id for r in named.collect()}) or flows(named, rows))
    assert value(whole=1_000) == want and not batched
    monkeypatch.setattr(packs, "STEPS_IN_TASK", 100)
    assert value(whole=1_000) == want and not batched
    assert value(whole=40) == want and batched == [{"k9"}]  # the ring and the chain are one weak component each, below the bound


def test_parts_of_large_projects(make_graph, monkeypatch):
    """A project of too many edges is taken apart into weak components; what stays too large is handed back."""
    nodes, edges = make_graph("abcdefghxyz", [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("f", "e"), ("g", "h"), ("x", "y"), ("x", "y"), ("y", "x")])
    ids = nodes.select("project_id", "node_id")
    of = {"d": "d", "e": "d", "f": "d", "g": "g", "h": "g", "z": "z"}
    for links, known in ((2_000_000, None), (3, None), (3, components.weak_components(nodes, edges).withColumnRenamed("component", "part"))):
        monkeypatch.setattr(components, "LINKS_IN_TASK", links)  # by hashes in a task, and in rounds
        held = components.parts(edges, 2, ids, known)
        rows = held.small.collect()
        assert sorted((r.source, r.target) for r in rows) == [("d", "e"), ("f", "e"), ("g", "h")] and held.count == 3
        assert sorted((r.source, r.target) for r in held.large.collect()) == [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("x", "y"), ("y", "x")]
        near, far = held.place(ids)
        placed = {r.node_id: r.part for r in near.collect()}
        assert set(placed) == set(of) and all((placed[a] == placed[b]) == (of[a] == of[b]) for a in of for b in of)
        assert all(r.part == placed[r.source] for r in rows) and {r.node_id for r in far.collect()} == set("abcxy")


@pytest.mark.parametrize("states", [1, 50, 2_000_000])
def test_walks_of_a_pack(states, monkeypatch):
    """Batches of any size give the distances and flows of a plain walk."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(packs, "STATES", states)
    rnd = random.Random(5)
    graphs = {f"p{i}": {(a, b) for a in "abcdefgh" for b in "abcdefgh" if rnd.random() < 0.15} for i in range(5)}
    rows = sorted((p, "", a, b, 1, 0) for p, pairs in graphs.items() for a, b in pairs)
    names = ("project_id", "part", "source", "target", "shares", "share")
    pack = packs.Pack(pa.table({k: pa.array(v) for k, v in zip(names, zip(*rows, strict=True), strict=True)}))
    walks, name = packs.Walks(pack, pack.source, pack.target), list(zip(pack.projects.to_pylist(), pack.names.to_pylist(), strict=True))
    for hops in (None, 2):
        got = defaultdict(dict)
        for roots, base, total in walks.batches(np.arange(pack.n)):
            dist = packs.distances(walks, roots, base, total, hops)
            places = np.flatnonzero(dist >= 0)
            for at, node, d in zip(*walks.nodes(roots, base, places), dist[places], strict=True):
                got[name[roots[at]]][name[node][1]] = d
        for p, n in name:
            assert got[p, n] == {k: d for k, d in bfs(adjacency((None, graphs[p])), n).items() if hops is None or d <= hops}


def test_reach_of_parts_in_tasks(world, scc, monkeypatch):
    """Walks in tasks give the rows of the walks in levels: with whole projects, with weak components of large ones, and with parts too large."""
    graphs, nodes, edges = world
    files, roots = nodes.select("project_id", F.col("node_id").alias("file")), nodes.select("project_id", F.col("node_id").alias("root"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(reach.impact(edges, files)), rows(reach.neighbourhood(edges, roots, 2)), rows(layering.feedback_edges(edges, scc))
    for whole, steps in ((1_000, 10**9), (1_000, 100), (12, 10**9)):
        monkeypatch.setattr(packs, "STEPS_IN_TASK", steps)
        levels, count = [], reach.cut_count
        monkeypatch.setattr(reach, "cut_count", lambda df: levels.append(1) or count(df))
        got = (rows(reach.impact(edges, files, whole=whole)), rows(reach.neighbourhood(edges, roots, 2, whole=whole)),
               rows(layering.feedback_edges(edges, scc, whole=whole)))
        assert got == want and bool(levels) == (whole == 12)
        monkeypatch.setattr(reach, "cut_count", count)


def test_reach_keeps_roots_without_a_name(spark, make_graph):
    """A root that is null, or in no project, reaches itself only, once."""
    _, edges = make_graph("ab", [("a", "b")])
    roots = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", None), ("p", None), (None, "a")], "project_id string, root string")
    rows = lambda **more: {(r.project_id, r.root, r.node) for r in reach.neighbourhood(edges, roots, 2, **more).collect()}
    assert rows(whole=10) == rows() == {("p", "a", "a"), ("p", "a", "b"), ("p", None, None), (None, "a", "a")}


def test_depth_with_and_without_rounds(world, scc, monkeypatch):
    _, nodes, edges = world
    rows = lambda: {(r.project_id, r.node_id): r.depth for r in components.dependency_depth(nodes, edges, scc).collect()}
    rounds, lengths = [], condense.chain_lengths
    monkeypatch.setattr(condense, "chain_lengths", lambda links: rounds.append(1) or lengths(links))
    want = rows()
    assert not rounds
    monkeypatch.setattr(packs, "EDGES_IN_TASK", 4)
    assert rows() == want and rounds
