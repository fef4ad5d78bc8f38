import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import jssource
from weftgraph.operators import extract, scan


def js(spark, text):
    df = spark.createDataFrame([(text,)], "c string")
    rows = df.select(F.explode(extract.js_parse(F.col("c"))["imports"]).alias("r")).select("r.*").collect()
    return [(r.specifier, r.type, r.symbols) for r in rows]


def test_js_forms(spark):
    text = """// import a from 'no1'
/* import b from "no2" */
import React, { useState as us, type Foo, /* don't */ useRef } from 'react';
import * as ns from "./ns"; import d, * as e from './e'
import './side.css';
import type { T } from './types';
import type U from './u';
const s = "import x from 'no3'"; const t = `import y from 'no4' ${1}`;
export { a as b, c } from './re';
export * from './star'; export * as q from "./starns"; export type { Z } from './z';
export const k = 1;
const db = require("./db"), { query, close: c2, "w-x": w, z = 1, n: { m }, ...rest } = require('./pool');
let f = require('./f').default;
require('./bare'); foo.require('no5');
const lazy = () => import('./lazy'); import("./l2", {x:1});
const m = require(`no6`); import z = require("no7");
const x1: Foo = require('./typed');
type Q = typeof import('no9');
import {
  one,
  two as three, // c'mment
} from './lines';
import ''; require(''); export {x}; import.meta.url;
"""
    assert js(spark, text) == [
        ("react", "import", ["default", "useState", "Foo", "useRef"]),
        ("./ns", "import", ["*"]), ("./e", "import", ["default", "*"]), ("./side.css", "import", []),
        ("./types", "import", ["T"]), ("./u", "import", ["default"]),
        ("./re", "re-export", ["a", "c"]), ("./star", "re-export", ["*"]),
        ("./starns", "re-export", ["*"]), ("./z", "re-export", ["Z"]),
        ("./db", "require", ["db"]), ("./pool", "require", ["query", "close", "w-x", "z", "n"]),
        ("./f", "require", []), ("./bare", "require", []), ("./lazy", "import", []), ("./l2", "import", []),
        ("./typed", "require", ["x1"]), ("./lines", "import", ["one", "two"]), ("", "require", []),
    ]


def found(text):
    error, records = jssource.parse_source(text)
    assert error is None, error
    return [(r["specifier"], r["type"], r["symbols"]) for r in records]


def test_js_regular_expressions():
    """A slash begins one by the token before it; quotes and brackets in it are text."""
    text = r"""const r = /`/; import a from './a';
const s = x.replace(/["'`/]/g, "'"), t = a / b; const u = require('./u'); if (ok) /'/.test(y); import('./v');
const w = (1 + 2) / 3 / arr[0] / 'import("no")'.length; function f() { return /[/'"]\/(/ } export * from './z';
const o = { a: 1 } / 2, p = [1] / 2, q = i++ / 2; require('./q'); x = y.in / 2; z = "/"; require('./s');
"""
    assert [s for s, _, _ in found(text)] == ["./a", "./u", "./v", "./z", "./q", "./s"]


def test_js_quoted_names():
    assert found("import { 'a-b' as c, type \"d e\" as f, type as g, type h } from './s'") == [("./s", "import", ["a-b", "d e", "type", "h"])]
    assert found("export { 'x-y' as z, default as w } from './t'; import type from './u'; import type, { v } from './v'") == [
        ("./t", "re-export", ["x-y", "default"]), ("./u", "import", ["default"]), ("./v", "import", ["default", "v"])]
    assert found(r"import './a\u0062\x63'; require('d\
e')") == [("./abc", "import", []), ("de", "require", [])]


def test_jsx_text():
    """Text of an element may hold quotes, backticks and what looks like an import; its braces are code."""
    text = """const A = () => <p className="it's" title={`t ${require('./t')}`}>don't `do` import x from 'no1' // {import('./b')} <B/> it's
  <C.D {...props} render={() => <i>require('no2')</i>}>{ok && <></>}</C.D></p>;
import e from './e'; const g = <T,>(x: T) => x; const h = <U extends V>(x: U) => import('./h');
const i = a < b, j = c > d; const k = f<W>('no3'); class K<X> extends L<M<X>> { n?: O<'no4'>; }
return <Q<R> s='require("no5")' /> ; export { l } from './l';
"""
    assert [s for s, _, _ in found(text)] == ["./t", "./b", "./e", "./h", "./l"]


def test_js_templates_and_bindings():
    text = """const a = `x ${ {b: `y ${import('./in')}`} } import('no') \\` z`, c = require('./c'); var d: Map<string, E> = require('./d'), f = 1;
const { g, 'h-i': j, [k]: l, m = { n: 1 }, ...o } = require('./g'); const [p] = require('./p'); q = require('./q');
const r = require('./r').s, t = require('./t')(), u = require('./u') as V, w = require('./w');
for (const x of require('./x')) {} foo(y, z = require('./z')); import A = require('no1'); new require('no2'); b.require('no3'); b.import('no4');
let B: import('./type').C; const D = await import('./D'); const E = import.meta.url; function F(G = require('./G')) {}
"""
    assert found(text) == [
        ("./in", "import", []), ("./c", "require", ["c"]), ("./d", "require", ["d"]), ("./g", "require", ["g", "h-i", "k", "m"]),
        ("./p", "require", []), ("./q", "require", []), ("./r", "require", []), ("./t", "require", []), ("./u", "require", []),
        ("./w", "require", ["w"]), ("./x", "require", []), ("./z", "require", []), ("./type", "import", []), ("./D", "import", []), ("./G", "require", [])]


@pytest.mark.parametrize("text", [
    "import { a from './a'", "f(1, [2)", "}", "const s = 'open", "const s = `open ${x", "/* open", "const a = <p>text", "const a = <p b={1>", "x = `a${b]`", "`\\"])
def test_js_syntax_errors(text):
    """A file that does not parse has an error and no imports, whatever stands before."""
    error, records = jssource.parse_source("import z from './z';\n" + text)
    assert error.startswith("parse failed: SyntaxError: ") and records == []
    assert "(2:" in error


def test_js_without_errors():
    for text in ["", "#!/usr/bin/env node\n'x'", "a = b / c; d = /[(]/; // )", "x = { '}': ']' }", "\u00e9t\u00e9 = `)`", "class A { #b = 1; static { c(); } }", "label: for (;;) {}"]:
        assert jssource.parse_source(text)[0] is None


def test_js_large_inputs_do_not_overflow(spark):
    text = '"' + '\\"x' * 200_000 + '"; /*' + "*a" * 200_000 + "*/ import z from './z';`" + "a\n" * 100_000 + "`"
    assert js(spark, text) == [("./z", "import", ["default"])]


def parsed(make_files, tree):
    return extract.parse(scan.kept(make_files(tree)))


def test_python_forms_and_order(spark, make_files):
    text = (
        "def f():\n    import late\nimport a.b as c, d\nfrom m.n import x, y as z\n"
        "from . import p, q\nfrom ..r import *\n"
    )
    rows = extract.imports(parsed(make_files, {"m.py": text})).orderBy("ordinal").collect()
    assert [(r.specifier, r.level, r.symbols) for r in rows] == [
        ("a.b", 0, ["a.b"]), ("d", 0, ["d"]), ("m.n", 0, ["x", "y"]), ("p", 1, ["*"]), ("q", 1, ["*"]),
        ("r", 2, ["*"]), ("late", 0, ["late"]),
    ]


def test_lines_and_errors(make_files):
    tree = {
        "ok.py": "import json\n", "cr.py": "a=1\rb=2\r\nc=3", "bad.py": "def (\n\n", "gone.py": None,
        "deep.py": "x = " + "1+" * 200_000 + "1", "nul.py": "x=1\0", "e.js": "", "cr.js": "a\rb\n", "gone.js": None, "bad.ts": "import a from './a';\nf({",
    }
    rows = {r.path: r for r in parsed(make_files, tree).collect()}
    loc = {k: r.lines_of_code for k, r in rows.items()}
    assert loc == {"ok.py": 2, "cr.py": 3, "bad.py": 3, "gone.py": 0, "deep.py": 1, "nul.py": 1,
                   "e.js": 1, "cr.js": 2, "gone.js": 0, "bad.ts": 2}
    failed = {k for k, r in rows.items() if r.error}
    assert failed == {"bad.py", "gone.py", "deep.py", "nul.py", "gone.js", "bad.ts"}
    assert rows["ok.py"].imports[0].specifier == "json"


def test_scan_rules(spark):
    rows = [("p", "a.js", 1, False), ("p", "node_modules/x.js", 1, False), ("p", ".git/x.py", 1, False),
            ("p", "x.JS", 1, False), ("p", "x.d.ts", 1, False), ("p", ".js", 1, False), ("p", "l.py", 1, True),
            ("p", "big.js", 2 * 1024 * 1024 + 1, False), ("p", "ok.js", 2 * 1024 * 1024, False)]
    df = spark.createDataFrame(rows, "project_id string, path string, size_bytes bigint, is_symlink boolean")
    got = {r.path: r.scan_status for r in scan.scan(df).collect()}
    assert got == {"a.js": "kept", "node_modules/x.js": "ignored_dir", ".git/x.py": "ignored_dir",
                   "x.JS": "extension", "x.d.ts": "kept", ".js": "extension", "l.py": "symlink",
                   "big.js": "oversized", "ok.js": "kept"}
    assert scan.rejected_projects(df, 2).count() == 1 and scan.admit_projects(df, 2).count() == 0


def test_batches_are_parsed_in_pieces(monkeypatch):
    """A batch is taken up in pieces, each handed on before the next is read, and memory goes back after it."""
    n = 3 * extract.PIECE + 5
    batch = pa.RecordBatch.from_pydict({
        "project_id": ["p"] * n, "path": [f"m{i}" for i in range(n)], "language": ["python", "javascript", None] * (n // 3) + ["python"] * (n % 3),
        "lines_of_code": [1] * n, "content": ["import a", "import 'b'", None] * (n // 3) + ["import ("] * (n % 3), "config_text": ["t"] * n})
    freed = []
    monkeypatch.setattr(extract, "give_back", lambda: freed.append(1))
    out = list(extract._parse_batches(iter([batch, batch.slice(0, 3)])))
    assert [b.num_rows for b in out] == [extract.PIECE] * 3 + [5, 3] and len(freed) == 2
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["path"] for r in rows[:n]] == [f"m{i}" for i in range(n)] and rows[0]["config_text"] == "t"
    assert rows[0]["imports"] == [{"specifier": "a", "level": 0, "type": "import", "symbols": ["a"]}] and rows[0]["error"] is None
    assert rows[1]["imports"][0]["specifier"] == "b" and rows[2]["imports"] is None and rows[2]["error"] is None
    assert rows[n - 1]["imports"] == [] and rows[n - 1]["error"].startswith("parse failed")
