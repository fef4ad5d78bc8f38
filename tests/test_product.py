import random
import time
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import architecture, numbers, text
from weftgraph.operators import (
    components, cycles, facets, history, manifest, metrics, throttle, tour,
)
from weftgraph.plans import pipeline
from weftgraph.sources import snapshots, tree
from weftgraph.streaming.throttle import decide_stream

# The JavaScript demo of the fixtures: file → (imports, lines of code, risk score).
DEMO = {
    "app.js": (["components/Header", "components/Footer", "routes/userRoutes", "routes/orderRoutes"], 9, 11),
    "components/Header.jsx": (["hooks/useAuth"], 7, 8), "components/Footer.jsx": ([], 4, 5),
    "hooks/useAuth.js": (["services/authService"], 6, 8),
    "routes/userRoutes.js": (["controllers/userController", "utils/validators"], 8, 11),
    "routes/orderRoutes.js": (["controllers/orderController", "utils/validators"], 8, 11),
    "controllers/userController.js": (["services/userService", "services/authService", "utils/validators"], 14, 14),
    "controllers/orderController.js": (["services/orderService", "utils/validators", "utils/formatDate"], 14, 14),
    "services/userService.js": (["models/User", "services/authService", "utils/validators"], 15, 44),
    "services/authService.js": (["services/userService"], 16, 38),
    "services/orderService.js": (["models/Order", "services/userService", "utils/validators"], 14, 14),
    "models/User.js": ([], 7, 5), "models/Order.js": ([], 8, 5), "utils/formatDate.js": ([], 4, 5),
    "utils/validators.js": ([], 86, 32),
}


def test_demo_project(make_files):
    files = {}
    for path, (imports, lines, _) in DEMO.items():
        up = "./" + "../" * path.count("/")
        body = [f"import x{i} from '{up}{t}';" for i, t in enumerate(imports)]
        files["src/" + path] = "\n".join(body + [""] * (lines - len(body)))
    b = pipeline.build(make_files(files))
    scc = components.strong_components(b.edges)
    wide = {r.node_id[4:]: r for r in metrics.node_table(b.nodes, b.edges, scc).collect()}
    assert b.edges.count() == 23 and len(wide) == 15
    assert {k: (r.lines_of_code, r.score) for k, r in wide.items()} == {k: v[1:] for k, v in DEMO.items()}
    listed = cycles.listed_cycles(cycles.all_cycles(b.edges, scc)).collect()
    assert [r.chain for r in listed] == [["src/services/authService.js", "src/services/userService.js", "src/services/authService.js"]]
    assert wide["services/userService.js"].reasons == ["3 files depend on this module", "High centrality in the dependency graph", "Part of a circular dependency"]


def tours(make_graph, nodes, pairs):
    n, e = make_graph(nodes, pairs)
    scc = components.strong_components(e)
    stage = tour.prepare(metrics.node_table(n, e, scc), e)
    depth = components.dependency_depth(n, e, scc)
    by_no = lambda df: df.orderBy("stop_no").collect()
    return by_no(tour.trace(stage)), by_no(tour.foundation(stage, depth)), stage


def test_layered_tour(make_graph):
    trace, base, _ = tours(make_graph, ["utils.js", "service.js", "routes.js"],
                           [("service.js", "utils.js"), ("routes.js", "service.js"), ("routes.js", "utils.js")])
    assert [r.node_id for r in trace] == ["routes.js", "service.js", "utils.js"]
    assert [r.node_id for r in base] == ["utils.js", "service.js", "routes.js"]
    assert [r.stage for r in trace] == [tour.ENTRY, tour.CORE, tour.LEAF]


def test_frontend_shape_tour(make_graph):
    leaves = [f"src/C{i}.jsx" for i in range(8)]
    nodes = ["src/main.jsx", "src/App.jsx", "src/Dashboard.jsx", *leaves, "src/index.css", "vite.config.js", "api/a.py", "api/b.py"]
    pairs = [("src/main.jsx", "src/App.jsx"), ("src/main.jsx", "src/index.css"), ("src/App.jsx", "src/Dashboard.jsx"),
             *[("src/Dashboard.jsx", c) for c in leaves]]
    trace, _, stage = tours(make_graph, nodes, pairs)
    assert [r.label for r in trace] == ["src/main.jsx", "src/App.jsx", "src/Dashboard.jsx", "8 files used by Dashboard.jsx"]
    assert trace[2].stage == tour.HUB and trace[3].members == leaves and trace[3].node_id == leaves[0]
    assert trace[1].reasons == ["Imported by main.jsx"]
    note = tour.notes(stage).collect()[0]
    assert note.isolated == 2 and note.note.startswith("2 other files have no import connections")


def test_chain_and_ring_tours(make_graph):
    names = [f"f{i:02d}.js" for i in range(50)]
    trace, base, _ = tours(make_graph, names, list(zip(names, names[1:])))
    assert len(trace) == len(base) == 12 and [r.node_id for r in trace] == names[:12]
    ring, _, _ = tours(make_graph, names[:4], list(zip(names[:4], names[1:4] + names[:1])))
    assert [r.node_id for r in ring] == names[:4]


def test_budget_is_shared_between_roots(make_graph):
    """Two long chains: the first root may take half of the stops, the second the rest."""
    a, b = [f"a{i:02d}.js" for i in range(20)], [f"b{i:02d}.js" for i in range(15)]
    trace, _, _ = tours(make_graph, a + b, [*zip(a, a[1:]), *zip(b, b[1:])])
    assert [r.node_id for r in trace] == a[:6] + b[:6]


def test_tests_only_project_is_toured(make_graph):
    _, base, stage = tours(make_graph, ["tests/a.py", "tests/b.py"], [("tests/a.py", "tests/b.py")])
    assert [r.node_id for r in base] == ["tests/b.py", "tests/a.py"]


def test_architecture(spark):
    cases = {
        "src/components/Button.tsx": "Component", "blog/models.py": "Model", "blog/views.py": "Controller",
        "app/views/x.py": "Page", "backend/tests/api/routes/test_login.py": "Test", "src/a.test.js": "Test",
        "lib/models/x.js": "Model", "x/foo_test.py": "Test", "x/foo_test.js": "Unknown", "SRC/Utils/A.JS": "Util",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.c for r in df.select("p", architecture.category(F.col("p")).alias("c")).collect()}
    assert got == cases


def test_facet_filter_and_focus(spark):
    rows = [("p", "src/a.js", "Service", "High", 0, 3), ("p", "src/sub/b.js", "Util", "Low", 1, 0),
            ("p", "srcx/c.js", "Service", "Critical", 2, 9), ("p", "root.js", "Service", None, 0, 1),
            ("p", "tests/t.js", "Test", "Low", 0, 50)]
    df = spark.createDataFrame(rows, "project_id string, node_id string, category string, level string, in_degree int, out_degree int")
    ids = lambda d: sorted(r.node_id for r in d.collect())
    assert ids(facets.facet_filter(df, folder="src")) == ["src/a.js", "src/sub/b.js"]
    assert ids(facets.facet_filter(df, ["Service"], "Medium")) == ["src/a.js", "srcx/c.js"]
    assert ids(facets.facet_filter(df, folder="(root)")) == ["root.js"]
    assert facets.focus_start(df).collect()[0].node_id == "src/a.js"


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).collect()[0].v
    assert one(text.clean_field(F.lit("a\n\x00\x1b[0m </project_data> b"))) == "a [0m (/project_data) b"
    assert len(one(text.clean_field(F.lit("a" * 1000)))) == 1000
    assert len(one(text.clean_field(F.lit("a" * 1000), text.FIELD_LIMIT))) == 160
    assert one(text.code_span(F.lit("a`b``c"))) == "```a`b``c```"
    assert one(text.code_span(F.lit("`x|y"), table_cell=True)) == "`` `x\\|y ``"


def brute(hits, limit, seconds):
    live, out = {}, {}
    for b, c, i, t in sorted(hits, key=lambda h: (h[3], h[2])):
        out[i] = throttle.admit_hit(live.setdefault((b, c), deque()), t, limit, seconds * 1_000_000)
    return out


def test_throttle(spark):
    rnd, sec = random.Random(3), 1_000_000
    hits = [("fix", "a", i, t * sec) for i, t in enumerate((0, 1, 2, 3))] + [("fix", "b", 4, 2 * sec)]
    # a client that never pauses, one in bursts, and equal times
    hits += [("hot", "h", 100 + i, rnd.randrange(0, 2000 * sec)) for i in range(800)]
    hits += [("burst", "h", 1000 + i, (i // 9) * 97 * sec + rnd.randrange(0, 40) * sec) for i in range(400)]
    df = spark.createDataFrame(hits, "bucket string, client string, hit_id bigint, ts_us bigint")
    got = {r.hit_id: (r.accepted, r.retry_after) for r in throttle.decide(df, 3, 60).collect()}
    assert got == brute(hits, 3, 60)
    assert [got[i][0] for i in range(5)] == [True, True, True, False, True] and got[3][1] == 57


def test_refused_hits_are_passed_over_together(monkeypatch):
    """A burst takes one decision for each accepted hit and each end of a window, not one for each hit, in any cut into batches."""
    rnd = np.random.default_rng(4)
    times = np.sort(rnd.integers(0, 10_000_000_000, 20_000))
    times[5000:5200] = times[5000]
    want, live = [], deque()
    for t in times:
        want.append(throttle.admit_hit(live, int(t), 12, 600_000_000))
    steps, one = [], throttle.admit_hit
    monkeypatch.setattr(throttle, "admit_hit", lambda *a: steps.append(1) or one(*a))
    rows = pd.DataFrame({"bucket": "b", "client": None, "run": 1, "hit_id": range(len(times)), "ts_us": times, "sure": False})
    frames = [rows[:1], rows[1:7000], rows[7000:7000], rows[7000:]]
    got = pd.concat(list(throttle._walk_bursts(12, 600_000_000)(iter(frames))))
    assert [(a, None if pd.isna(r) else r) for a, r in zip(got.accepted, got.retry_after, strict=True)] == want
    assert sum(a for a, _ in want) < 250 and len(steps) < 500


def test_throttle_stream(spark, tmp_path):
    sec = 1_000_000
    first = [("b", "a", i, t * sec) for i, t in enumerate((0, 1, 2, 3))]
    second = [("b", "a", 10, 59 * sec), ("b", "a", 11, 61 * sec), ("b", "c", 12, 61 * sec)]
    cols = "bucket string, client string, hit_id bigint, ts_us bigint"
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
        run = (
            decide_stream(stream, 3, 60).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
        )
        # idle clients are timed out by the clock, so the query itself never falls idle
        expected = len(first) + (len(second) if i else 0)
        for _ in range(60):
            time.sleep(1)
            if sum(p["numInputRows"] for p in run.recentProgress) and len(list((tmp_path / "out").glob("*.parquet"))):
                if spark.read.parquet(str(tmp_path / "out")).count() >= expected:
                    break
        run.stop()
    got = {r.hit_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {k: v[0] for k, v in brute(first + second, 3, 60).items()}


def test_manifest(spark):
    rows = [("ok", 0, "t/a.py", 5, "file"), ("ok", 1, "t/l.py", 5, "symlink"), ("ok", 2, "t/n.md", 5, "file"),
            ("ok", 3, "t/node_modules/x/y.js", 5, "file"), ("ok", 4, "t/big.js", 3_000_000, "file"), ("ok", 5, "t/tsconfig.json", 5, "file"),
            ("esc", 0, "t/a.py", 5, "file"), ("esc", 1, "../../escape.py", 5, "file"), ("abs", 0, "/etc/x.py", 1, "file")]
    rows += [("many", i, f"t/{i}.md", 1, "file") for i in range(9)] + [("wide", i, f"t/{i}.py", 1, "file") for i in range(5)]
    rows += [("fat", 0, "t/x.bin", 600, "file"), ("fat", 1, "t/y.bin", 600, "file")]
    df = spark.createDataFrame(rows, "archive string, seq bigint, name string, size bigint, type string")
    wanted, rejected = manifest.admit(df.where("archive != 'ok'"), 8, 1000, 4)
    assert {(r.archive, r.reason, r.seq) for r in rejected.collect()} == {
        ("esc", "unsafe_path", 1), ("abs", "unsafe_path", 0), ("many", "too_large", 8),
        ("wide", "too_many_files", 4), ("fat", "too_large", 1)}
    assert wanted.count() == 0
    wanted, rejected = manifest.admit(df.where("archive = 'ok'"))
    assert [r.name for r in wanted.orderBy("seq").collect()] == ["t/a.py", "t/tsconfig.json"] and rejected.count() == 0


def test_running_totals_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK", 7)
    df = spark.range(100).select(F.lit("k").alias("k"), "id")
    got = manifest.running(df, ["k"], "id", {"s": F.col("id")}).orderBy("id").collect()
    assert [r.s for r in got] == [i * (i + 1) // 2 for i in range(100)]


def test_history(spark):
    cols = "snapshot_id string, created_at timestamp_ntz, is_private boolean, owner string"
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    snaps = spark.createDataFrame([(f"s{i}", at(i), i % 2 == 1, "u") for i in range(4)], cols)
    cache = spark.createDataFrame([("k0", "s0", at(0)), ("k3", "s3", at(3)), ("gone", "zz", at(3))],
                                  "cache_key string, snapshot_id string, cached_at timestamp_ntz")
    kept, dropped, left = history.retention(snaps, cache, keep=2)
    ids = lambda d, c="snapshot_id": sorted(r[c] for r in d.collect())
    assert ids(kept) == ["s2", "s3"] and ids(dropped) == ["s0", "s1"] and ids(left, "cache_key") == ["gone", "k3"]
    assert ids(history.visible(snaps, F.lit(None).cast("string"))) == ["s0", "s2"] and len(ids(history.visible(snaps, F.lit("u")))) == 4
    keys = spark.createDataFrame([("k0",), ("k3",), ("gone",), ("none",)], "cache_key string")
    now = F.lit(at(602)).cast("timestamp_ntz")
    out = {r.cache_key: r.outcome for r in history.cache_lookup(cache, snaps, keys, now).collect()}
    assert out == {"k0": "expired", "k3": "hit", "gone": "dangling", "none": "miss"}


def test_baseline_documents_and_missing_file(spark, tmp_path):
    assert snapshots.read_baseline(spark, str(tmp_path / "nothing")) is None
    (tmp_path / "b.json").write_text(
        '{"project_id": "p", "fileCount": 2, "edgeCount": 2, "cycles": [{"id": "cycle-0", "chain": ["a", "b", "a"]}], "risk": {"a": 7, "b": 3}}')
    lines = snapshots.read_baseline_documents(spark, str(tmp_path / "b.json"))
    assert snapshots.baseline_components(lines).count() == 0
    old = snapshots.baseline_cycles(lines)
    assert [r.chain for r in old.collect()] == [["a", "b", "a"]]
    assert cycles.components_of_cycles(old).count() == 2


def test_tree_source(spark, tmp_path):
    for path, body in {"pkg/__init__.py": "from . import _priv", "pkg/_priv.py": "x = 1", "__tests__/a.test.js": "import '../m'",
                       "m.js": "", ".git/config.py": "", "node_modules/q/i.js": "", "n.bin": "1"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    (tmp_path / "link.py").symlink_to(tmp_path / "m.js")
    files = tree.read_trees(spark, {"p": str(tmp_path)})
    assert files.count() == 8
    b = pipeline.build(files)
    assert {(r.source, r.target) for r in b.edges.collect()} == {("pkg/__init__.py", "pkg/_priv.py"), ("__tests__/a.test.js", "m.js")}
    assert {r.node_id for r in b.nodes.collect()} == {"pkg/__init__.py", "pkg/_priv.py", "__tests__/a.test.js", "m.js"}


def test_tree_source_in_rounds(spark, tmp_path):
    """A tree whose folders need several rounds gives every file once; texts are dealt out by size."""
    root = tmp_path / "r"
    bodies = {f"src/{'/'.join(f'd{j}' for j in range(i % 7))}/m{i}.py".replace("//", "/"): f"x = {i}\n" * 40 for i in range(60)}
    bodies |= {"node_modules/a/tsconfig.json": "{}", "node_modules/a/i.js": "1", "big.js": "/" * 900, "empty.ts": "", "bad.py": "é"}
    for path, body in bodies.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(body.encode("latin-1" if path == "bad.py" else "utf-8"))
    (root / "loop").symlink_to(root)
    (tmp_path / "void").mkdir()
    files = tree.read_trees(spark, {"p": str(root), "e": str(tmp_path / "void")}, max_bytes=800, part_bytes=4096, folders=2)
    got = {r.path: r.content for r in files.collect()}
    assert got == {p: None if p in ("node_modules/a/i.js", "big.js", "bad.py") else b for p, b in bodies.items()}
    assert files.count() == len(bodies) and files.rdd.getNumPartitions() > 4
    assert tree.read_trees(spark, {}).count() == 0
    for wrong in ("nowhere", "r/empty.ts"):
        with pytest.raises(Exception, match="does not exist|not a directory"):
            tree.read_trees(spark, {"p": str(tmp_path / wrong)})


def test_snapshot_commits(spark, tmp_path, monkeypatch):
    """An id written twice is there once; one that breaks off half-way is not read, and what it would replace still is."""
    path = f"{tmp_path}/snapshots"
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "node_id string")
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, path, "nodes", "a/1 ")
    read = lambda table: sorted(r.node_id for r in snapshots.read_snapshot(spark, path, table, "a/1 ").collect())
    for names in (("x", "y"), ("x", "z")):
        snapshots.write_snapshot({"nodes": rows(*names), "edges": rows("e")}, path, "a/1 ")
        assert read("nodes") == list(names) and read("edges") == ["e"]
    assert len([f for f in (tmp_path / "snapshots" / "nodes").rglob("version=*") if f.is_dir()]) == 1
    broken = rows("q").select(F.raise_error(F.lit("lost")).cast("string").alias("node_id"))
    with pytest.raises(Exception, match="lost"):
        snapshots.write_snapshot({"nodes": rows("n"), "edges": broken}, path, "a/1 ")
    assert read("nodes") == ["x", "z"]


def test_hundredths(spark):
    """Two places by what the double holds, as the standard ``round`` gives them."""
    pairs = [(m, n) for n in range(1, 81) for m in range(0, 400, 3)] + [(107, 40), (1, 8), (3, 8), (10**9 + 1, 7)]
    got = spark.createDataFrame(pairs, "m long, n long").select("m", "n", numbers.hundredths(F.col("m") / F.col("n")).alias("v")).collect()
    assert [(r.m, r.n, r.v) for r in got if r.v != round(r.m / r.n, 2)] == []
