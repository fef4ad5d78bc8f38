from weftgraph.operators import alias
from weftgraph.plans import pipeline


def edges(make_files, edge_set, tree):
    return edge_set(pipeline.build(make_files(tree)).edges)


def test_pipeline_fixture(make_files):
    b = pipeline.build(make_files({
        "app.js": "import React from 'react';\nimport B from './components/Button';\nimport x from './does-not-exist';",
        "components/Button.jsx": "import React from 'react'",
    }))
    assert [(r.source, r.target) for r in b.edges.collect()] == [("app.js", "components/Button.jsx")]
    assert [(r.specifier, r.n) for r in b.external_deps.collect()] == [("react", 2)]
    assert [(r.file, r.specifier) for r in b.unresolved.collect()] == [("app.js", "./does-not-exist")]


def test_js_probe_order(make_files, edge_set):
    got = edges(make_files, edge_set, {
        "m.js": "import './a'; import './b'; import './c.css'; import './lib'; import '/abs'; import '../up';",
        "a.ts": "", "a.jsx": "", "a/index.js": "", "b/index.tsx": "", "b/index.ts": "", "c.css": "x",
        "lib.d.ts": "", "lib/index.js": "import '.'; import '..';", "index.js": "",
    })
    assert got == {("m.js", "a.jsx"), ("m.js", "b/index.ts"), ("m.js", "c.css"), ("m.js", "lib.d.ts"),
                   ("lib/index.js", "lib.d.ts"), ("lib/index.js", "index.js")}


def test_targets_outside_the_scan_become_nodes(make_files):
    b = pipeline.build(make_files({"a.js": "import './dist/x'; import './s.css'", "dist/x.js": "a\nb", "s.css": ""}))
    got = {r.node_id: (r.lines_of_code, r.language) for r in b.nodes.collect()}
    assert got == {"a.js": (1, "javascript"), "dist/x.js": (0, "javascript"), "s.css": (0, "javascript")}


def test_edge_merge(make_files):
    b = pipeline.build(make_files({
        "a.js": "import {x} from './b'; const {y, y: z, x: q} = require('./b');",
        "b.js": "", "tsconfig.json": '{"compilerOptions":{"paths":{"@/*":["./*"]}}}',
        "c.js": "const k = require('./b'); import {late} from '@/b';",
    }))
    got = {r.source: (r.type, r.symbols) for r in b.edges.collect()}
    # a later list is filtered only against what came before it; alias imports merge first
    assert got == {"a.js": ("import", ["x", "y", "y"]), "c.js": ("import", ["late", "k"])}


def test_cross_language(make_files, edge_set):
    got = edges(make_files, edge_set, {
        "src/utils.py": "", "src/utils.js": "", "src/app.py": "from . import utils", "src/app.js": "import './utils'",
    })
    assert got == {("src/app.py", "src/utils.py"), ("src/app.js", "src/utils.js")}


def test_python_roots(make_files, edge_set):
    got = edges(make_files, edge_set, {
        "backend/main.py": "from routes.sim import r\nimport json\nimport shared\nfrom pkg import sub\nimport lib.x",
        "backend/routes/sim.py": "import models", "backend/models.py": "", "backend/json.py": "",
        "shared.py": "", "backend/shared.py": "", "src/pkg/__init__.py": "", "src/pkg/sub.py": "", "lib/x/__init__.py": "",
        "top/t.py": "import json", "json/__init__.py": "",
    })
    assert got == {
        ("backend/main.py", "backend/routes/sim.py"), ("backend/main.py", "json/__init__.py"),
        ("backend/main.py", "shared.py"), ("backend/main.py", "src/pkg/__init__.py"),
        ("backend/main.py", "lib/x/__init__.py"), ("backend/routes/sim.py", "backend/models.py"),
        ("top/t.py", "json/__init__.py"),
    }


def test_python_relative_and_bare_dot(make_files):
    b = pipeline.build(make_files({
        "pkg/__init__.py": "from . import name, gone", "pkg/name.py": "",
        "pkg/a.py": "from . import name, singleton\nfrom .missing import *\nfrom .nope import x\nfrom ... import far",
        "solo/b.py": "from . import unknown", "pkg/sub/c.py": "from ..name import q",
    }))
    assert {(r.source, r.target) for r in b.edges.collect()} == {
        ("pkg/__init__.py", "pkg/name.py"), ("pkg/a.py", "pkg/name.py"), ("pkg/a.py", "pkg/__init__.py"),
        ("pkg/sub/c.py", "pkg/name.py"),
    }
    assert {(r.file, r.specifier) for r in b.unresolved.collect()} == {
        ("pkg/__init__.py", "gone"), ("pkg/a.py", "nope"), ("pkg/a.py", "far"), ("solo/b.py", "unknown"),
    }


def test_alias_status(make_files):
    b = pipeline.build(make_files({
        "tsconfig.json": '// c\n{"compilerOptions": {"paths": {"@/*": ["./src/*",],},},}',
        "src/Button.tsx": "import {cn} from '@/lib/utils'; import {other} from '../src/lib/utils';"
                          "import r from 'react'; import n from '@/lib/nope'; import p from 'node:fs'",
        "src/lib/utils.ts": "",
    }))
    assert [(r.target, r.symbols) for r in b.edges.collect()] == [("src/lib/utils.ts", ["cn", "other"])]
    assert {(r.specifier, r.n) for r in b.external_deps.collect()} == {("react", 1), ("node:fs", 1)}
    assert [r.specifier for r in b.unresolved.collect()] == ["@/lib/nope"]


def test_alias_extends_baseurl_and_nearest(make_files, edge_set):
    got = edges(make_files, edge_set, {
        "tsconfig.base.json": '{"compilerOptions": {"paths": {"@lib/*": ["./libs/*"]}}}',
        "apps/web/tsconfig.json": '{"extends": "../../tsconfig.base.json", "compilerOptions": {"baseUrl": "./src"}}',
        "apps/web/src/a.ts": "import '@lib/core'; import 'feature/x'; import '@/z'",
        "libs/core.ts": "", "apps/web/src/feature/x.ts": "", "apps/web/src/libs/core.ts": "", "apps/web/src/z.ts": "",
    })
    # paths are joined to baseUrl when there is one
    assert got == {("apps/web/src/a.ts", "apps/web/src/libs/core.ts"), ("apps/web/src/a.ts", "apps/web/src/feature/x.ts"),
                   ("apps/web/src/a.ts", "apps/web/src/z.ts")}


def test_alias_extends_without_baseurl(make_files, edge_set):
    got = edges(make_files, edge_set, {
        "tsconfig.base.json": '{"compilerOptions": {"paths": {"@lib/*": ["./libs/*"]}}}',
        "apps/web/tsconfig.json": '{"extends": "../../tsconfig.base"}',
        "apps/web/a.ts": "import '@lib/core'", "libs/core.ts": "",
    })
    assert got == {("apps/web/a.ts", "libs/core.ts")}


def test_alias_extends_cycle_and_list(make_files, edge_set):
    got = edges(make_files, edge_set, {
        "x/tsconfig.json": '{"extends": "./b.json"}', "x/b.json": '{"extends": "./tsconfig.json"}',
        "x/m.ts": "import '@/a'", "x/src/a.ts": "",
        "y/tsconfig.json": '{"extends": ["./one", "./two.json"]}',
        "y/one.json": '{"compilerOptions": {"paths": {"~/*": ["one/*"]}}}',
        "y/two.json": '{"compilerOptions": {"paths": {"~/*": ["two/*"]}}}',
        "y/m.ts": "import '~/k'", "y/one/k.ts": "", "y/two/k.ts": "",
    })
    assert got == {("x/m.ts", "x/src/a.ts"), ("y/m.ts", "y/two/k.ts")}


def test_alias_rule_order(make_files, edge_set):
    got = edges(make_files, edge_set, {
        "tsconfig.json": '{"compilerOptions": {"paths": {"*": ["any/*"], "@a/*": ["short/*"], "@a/b/*": ["long/*"],'
                         '"@a/b/exact": ["exact.ts"], "q*.css": ["css/*"], "w*x*": ["no/*"], "e": []}}}',
        "m.ts": "import '@a/b/c'; import '@a/b/exact'; import '@a/z'; import 'qq.css'; import 'free'; import 'wwxx'",
        "long/c.ts": "", "short/b/c.ts": "", "exact.ts": "", "long/exact.ts": "", "short/z.ts": "", "css/q": "",
        "any/free.ts": "", "no/w": "",
    })
    assert got == {("m.ts", t) for t in ("long/c.ts", "exact.ts", "short/z.ts", "css/q", "any/free.ts")}


def test_vite_aliases(make_files, edge_set):
    shapes = {
        "o1": "path.resolve(__dirname, './s', 'one')", "o2": "fileURLToPath(new URL('./s/two', import.meta.url))",
        "o3": "__dirname + '/s/three'", "o4": "resolve(process.cwd(), 's/four')", "o5": "'/s/five'",
    }
    entries = ",\n".join(f"'{k}': {v}" for k, v in shapes.items())
    tree = {
        "vite.config.ts": "export default { resolve: { alias: {\n// 'o6': './s/six',\n" + entries + ",\nbare: './s' } } }",
        "sub/vite.config.js": "const c = { resolve: { alias: [ {find: '@', replacement: path.join(__dirname, 'src')},"
                              " {find: \"#x\", replacement: './exact'} ] } }",
        "m.js": "".join(f"import '{k}/f';" for k in shapes) + "import 'bare/one/f'; import 'o6/f'; import 'o1'",
        "sub/m.js": "import '@/f'; import '#x'; import 'o1/f'",
        "sub/src/f.js": "", "sub/exact.js": "", "s/one/index.js": "",
    }
    tree.update({f"s/{d}/f.js": "" for d in ("one", "two", "three", "four", "five", "six")})
    got = edges(make_files, edge_set, tree)
    assert got == {("m.js", f"s/{d}/f.js") for d in ("one", "two", "three", "four", "five")} | {
        ("m.js", "s/one/index.js"), ("sub/m.js", "sub/src/f.js"), ("sub/m.js", "sub/exact.js"), ("sub/m.js", "s/one/f.js"),
    }


def test_vite_values_that_name_no_path(make_files):
    values = {
        "a": "normalizePath(path.posix.join(__dirname, 's', 'one'))", "b": "path.resolve(__dirname, folder)", "c": "resolve('/abs', 's')",
        "d": "path.resolve(__dirname)", "e": "process.env.SRC", "f": "new URL('./s', base)", "g": "resolve(process.cwd())",
        "h": "path.dirname(__dirname + '/s')", "i": "load('./s')", "j": "path.join('s', 'two')",
    }
    entries = ", ".join(f"{k}: {v}" for k, v in values.items())
    files = make_files({"w/vite.config.ts": "export default { resolve: { alias: { " + entries + " } } }"})
    got = {r.key: r.target for r in alias.vite_aliases(alias.config_texts(files)).collect()}
    assert got == {"a": "w/s/one", "c": alias.OUTSIDE, "d": "w", "h": "w/s", "j": "w/s/two"}


def test_rules_tie_in_written_order(make_files):
    files = make_files({"tsconfig.json": '{"files": ["@b/*", "@a/*"], "compilerOptions": {"paths": {"@a/*.x": ["1/*"], "@a/*": ["2/*"]}}}'})
    assert [r.targets for r in alias.rules(files).orderBy("rule_rank").collect()] == [["1/*"], ["2/*"]]


def test_extends_limits(make_files):
    tree = {f"c{i}.json": f'{{"extends": "./c{i + 1}.json"}}' for i in range(10)}
    tree |= {"tsconfig.json": '{"extends": "./c0"}', "c10.json": '{"extends": "./last"}',
             "last": '{"compilerOptions": {"paths": {"@/*": ["./deep/*"]}}}'}
    files = make_files(tree)
    assert alias.rules(files).count() == 0
    assert [r.targets for r in alias.rules(files, max_extends=None).collect()] == [["deep/*"]]
    assert alias.rules(files, max_bytes=10, max_extends=None).count() == 0


def test_aliased_build_reads_text_once(make_files, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    path = str(tmp_path / "files")
    files = make_files({
        "tsconfig.json": '{"extends": "./conf/base"}', "conf/base.json": '{"compilerOptions": {"paths": {"@/*": ["../src/*"]}}}',
        "vite.config.ts": "import x from './src/b'; export default { resolve: { alias: { '#': './src' } } }",
        "src/a.ts": "import '@/b'; import '#/c'", "src/b.ts": "", "src/c.ts": "",
    })
    files.write.parquet(path)
    plans, write = [], DataFrameWriter.parquet

    def spied(self, *args, **more):
        plans.append(self._df._jdf.queryExecution().executedPlan().treeString())
        return write(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    b = pipeline.build(files.sparkSession.read.parquet(path))
    assert {(r.source, r.target) for r in b.edges.collect()} == {
        ("src/a.ts", "src/b.ts"), ("src/a.ts", "src/c.ts"), ("vite.config.ts", "src/b.ts")}
    text = [line for plan in plans for line in plan.splitlines() if path in line and "content:string" in line]
    assert len(text) == 1
