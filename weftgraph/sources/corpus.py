"""Project corpora derived from the benchmark tables.

The tables hold no source code, so ``part`` rows become files (project =
brand) and consecutive line items of one order and brand become imports.
Everything is derived by Spark from the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.session import cut

FOLDERS = (
    "components", "controllers", "services", "models", "middleware", "routes", "hooks", "pages",
    "config", "utils", "lib", "tests", "core",
)
SUFFIXES = (".js", ".jsx", ".ts", ".tsx")
# Number of key ranges of a corpus. Edges between two ranges run from the higher one to the lower one, edges within a range
# keep the direction of their line items: the more ranges, the fewer cycles.
CLEAN, KNOTTED, TANGLED = 4, 2, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, p, brand_no, is_py, folder, path, p_size) for every part."""
    brand_no = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    p = F.col("p_partkey")
    folder = _pick(FOLDERS, p % len(FOLDERS))
    return (
        table(spark, sf_dir, "part")
        .select(F.col("p_brand").alias("project_id"), p.alias("p"), brand_no.alias("brand_no"),
                folder.alias("folder"), "p_size")
        .withColumn("is_py", F.col("brand_no") % 2 == 1)
        .withColumn(
            "path",
            F.when(F.col("is_py"), F.concat(F.lit("app/"), "folder", F.lit("/m"), F.col("p").cast("string"), F.lit(".py")))
            .otherwise(F.concat(F.lit("src/"), "folder", F.lit("/m"), F.col("p").cast("string"),
                                _pick(SUFFIXES, F.col("p") % 4))),
        )
    )


def part_edges(spark: SparkSession, sf_dir: str, ranges: int) -> DataFrame:
    """(project_id, a, b): each line item of an order to the next one of the same brand, turned by the key ranges."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("project_id")
    )
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity"
    )
    w = Window.partitionBy("l_orderkey", "project_id").orderBy("l_linenumber", "l_partkey", "l_quantity")
    n = table(spark, sf_dir, "part").count()  # from the file footers
    at = lambda key: F.floor(F.col(key) * ranges / n)  # keys run from 0
    up = at("a") < at("b")
    return (
        line.join(part, "l_partkey")
        .select("project_id", F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b"))
        .where(F.col("a") != F.col("b"))
        .select("project_id", F.when(up, F.col("b")).otherwise(F.col("a")).alias("a"),
                F.when(up, F.col("a")).otherwise(F.col("b")).alias("b")).distinct()
    )


STYLES = ("plain", "aliased", "varied")


def _varied_line(name: Column) -> Column:
    """One of five import forms per language, chosen by the edge's two keys."""
    k = (F.col("a") + F.col("b")) % 5
    text = lambda *bits: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in bits])
    folder, suffix = F.col("folder"), _pick(SUFFIXES, F.col("b") % 4)
    js = (
        F.when(k == 0, text("import { 's", name, "' as x", name, " } from '../", folder, "/m", name, "';\n"))
        .when(k == 1, text("export { s", name, " as y", name, " } from '../", folder, "/m", name, suffix, "';\n"))
        .when(k == 2, text("const q", name, " = /[`'\"/]`/g; const { s", name, ": z", name, " } = require('../", folder, "/m", name, "');\n"))
        .when(k == 3, text('export * from "../', folder, "/m", name, '";\n'))
        .otherwise(text("const l", name, " = () => import('../", folder, "/m", name, "');\n"))
    )
    py = (
        F.when(k == 0, text("from app.", folder, ".m", name, " import s", name, " as x\n"))
        .when(k == 1, text("from ..", folder, ".m", name, " import s", name, "\n"))
        .when(k == 2, text("import app.", folder, ".m", name, " as q\n"))
        .when(k == 3, text("from ", folder, ".m", name, " import *\n"))
        .otherwise(text("def f", name, "():\n    from ..", folder, ".m", name, " import s", name, "\n"))
    )
    return F.when(F.col("is_py"), py).otherwise(js)


def _import_lines(spark: SparkSession, sf_dir: str, ranges: int, style: str) -> DataFrame:
    """(project_id, p, lines): import statements of each importing file, by target key."""
    targets = parts(spark, sf_dir).select(
        "project_id", F.col("p").alias("b"), "folder", "is_py"
    )
    aliased = style == "aliased"
    name = F.col("b").cast("string")
    prefix = F.lit("@/") if aliased else F.lit("../")
    line = F.when(
        F.col("is_py"),
        F.concat(F.lit("from app."), "folder", F.lit(".m"), name, F.lit(" import s"), name, F.lit("\n")),
    ).otherwise(
        F.concat(F.lit("import { s"), name, F.lit(" } from '"), prefix, "folder", F.lit("/m"), name, F.lit("';\n"))
    )
    return (
        part_edges(spark, sf_dir, ranges).join(targets, ["project_id", "b"])
        .select("project_id", F.col("a").alias("p"), "b",
                (_varied_line(name) if style == "varied" else line).alias("line"))
        .groupBy("project_id", "p")
        .agg(F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("b", "line"))), lambda e: e["line"]), ""
        ).alias("lines"), F.count(F.lit(1)).cast("int").alias("n_edges"))
    )


def files(spark: SparkSession, sf_dir: str, ranges: int, style: str = "plain") -> DataFrame:
    """The ``files`` table: generated source text of every part."""
    base = parts(spark, sf_dir)
    lines = _import_lines(spark, sf_dir, ranges, style)
    p = F.col("p").cast("string")
    none = F.lit("")
    external = F.when(
        F.col("p") % 3 == 0,
        F.when(F.col("is_py"), "import json\n").otherwise("import React from 'react';\n"),
    ).otherwise(none)
    broken = F.when(
        F.col("p") % 17 == 0,
        F.when(F.col("is_py"), F.concat(F.lit("from .missing"), p, F.lit(" import x\n")))
        .otherwise(F.concat(F.lit("import x from './missing"), p, F.lit("';\n"))),
    ).otherwise(none)
    comment = F.when(F.col("is_py"), "# padding\n").otherwise("// padding\n")
    content = F.concat(
        external, F.coalesce("lines", none), broken, F.repeat(comment, F.col("p_size") * 10)
    )
    out = base.join(lines, ["project_id", "p"], "left").withColumn("content", content).select(
        "project_id", "path", F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.lit(False).alias("is_symlink"), "content",
    )
    return out.unionByName(configs(spark, sf_dir)) if style == "aliased" else out


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alias config set per JS project, in three dialects by brand number."""
    js = (
        parts(spark, sf_dir).where(~F.col("is_py")).select("project_id", "brand_no").distinct()
        .withColumn("style", F.col("brand_no") % 3)
    )
    commented = (
        '{\n  // "paths": {"@/*": ["./wrong/*"]},\n  "compilerOptions": {\n    "baseUrl": ".", /* root */\n'
        '    "paths": {"@/*": ["./src/*",], "bad": "not-a-list"},\n  },\n}\n'
    )
    child = '{"extends": "./config/base", "compilerOptions": {"strict": true}}'
    parent = '{"compilerOptions": {"paths": {"@/*": ["../src/*"]}}}'
    vite = (
        "export default {\n  resolve: {\n    alias: {\n      // '@': './wrong',\n"
        "      '@': path.resolve(__dirname, './src'),\n    },\n  },\n}\n"
    )
    one = lambda path, text: F.struct(F.lit(path).alias("path"), F.lit(text).alias("content"))
    sets = (
        F.when(F.col("style") == 0, F.array(one("tsconfig.json", commented)))
        .when(F.col("style") == 1, F.array(one("tsconfig.json", child), one("config/base.json", parent)))
        .otherwise(F.array(one("vite.config.ts", vite)))
    )
    return js.select("project_id", F.explode(sets).alias("c")).select(
        "project_id", "c.path", F.octet_length("c.content").cast("bigint").alias("size_bytes"),
        F.lit(False).alias("is_symlink"), "c.content",
    )


def crossroads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` in which every part makes one import that a rule of its own decides, with the files that compete for it.

    By key: a path alias, the nearer of two configs, the longer of two patterns, the nearest ``src`` folder, aliases without
    a file, a rule into ``node_modules``, a path that climbs out, the forms of vite aliases, a bare dot, dots beyond the root, ``baseUrl``.
    """
    m, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 12
    text = lambda *bits: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in bits])
    file = lambda path, content=F.lit(""): F.struct(path.alias("path"), content.alias("content"))
    importer = lambda folder, *spec: file(text(folder, "/m", m, ".ts"), text("import '", *spec, "';\n"))
    target = lambda folder: file(text(folder, "/m", m, "t.ts"))
    form = (F.floor(F.col("p_partkey") / 12) % 5 + 1).cast("string")
    cases = (
        (importer("src", "@lib/m", m, "t"), target("libs")),
        (importer("near", "@lib/m", m, "t"), target("near/own"), target("libs")),
        (importer("src", "@lib/x/m", m, "t"), target("xlibs"), target("libs/x")),
        (importer("web/in", "@/m", m, "t"), target("web/src"), target("src")),
        (importer("web/in", "@/m", m, "t"),),
        (importer("src", "@gone/m", m, "t"), target("libs")),
        (importer("src", "@mod/m", m, "t"),),
        (importer("src", "../../m", m, "t"), file(text("m", m, "t.ts"))),
        (importer("v", "a", form, "/m", m, "t"), file(text("v/v", form, "/m", m, "t.ts")), file(text("v", form, "/m", m, "t.ts"))),
        (file(text("pk", m, "/__init__.py"), F.lit("x = 1\n")), file(text("pk", m, "/m.py"), F.lit("from . import zz\n"))),
        (file(text("src/m", m, ".py"), F.lit("from ...x import y\n")), file(text("x", m, ".py"))),
        (importer("src", "libs/m", m, "t"), target("libs")),
    )
    made = F.lit(None)
    for i, case in enumerate(cases):
        made = F.when(k == i, F.array(*case)).otherwise(made)
    settings = {
        "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["libs/*"], "@lib/x/*": ["xlibs/*"],\n'
                         '"@gone/*": ["gone/*"], "@mod/*": ["node_modules/*"]}}}',
        "near/tsconfig.json": '{"extends": "./conf", "compilerOptions": {"strict": true}}',
        "near/conf.json": '{"compilerOptions": {"paths": {"@lib/*": ["./own/*"]}}}',
        "v/vite.config.ts": "export default { resolve: { alias: {\n  a1: path.resolve(__dirname, 'v1'),\n"
                            "  a2: fileURLToPath(new URL('./v2', import.meta.url)),\n  a3: __dirname + '/v3',\n"
                            "  'a4': resolve(process.cwd(), 'v4'), \"a5\": '/v5' } } }\n",
    }
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "project_id")
    config = F.array(*[file(F.lit(path), F.lit(content)) for path, content in settings.items()])
    rows = part.select("project_id", F.explode(made).alias("f")).unionByName(
        part.select("project_id").distinct().select("project_id", F.explode(config).alias("f")))
    return rows.select("project_id", "f.path", F.octet_length("f.content").cast("bigint").alias("size_bytes"),
                       F.lit(False).alias("is_symlink"), "f.content")


def graph(spark: SparkSession, sf_dir: str, ranges: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the same corpus straight from the tables, without the text.

    ``edges_clean`` and ``edges_tangled`` check that reading the text back
    gives exactly these edges. The line items are read once: nodes and edges go on from the written pairs.
    """
    base = parts(spark, sf_dir)
    pairs = cut(part_edges(spark, sf_dir, ranges))
    degree = pairs.groupBy("project_id", F.col("a").alias("p")).agg(
        F.count(F.lit(1)).cast("int").alias("n_edges")
    )
    extra = (F.col("p") % 3 == 0).cast("int") + (F.col("p") % 17 == 0).cast("int")
    nodes = base.join(degree, ["project_id", "p"], "left").select(
        "project_id", F.col("path").alias("node_id"),
        F.substring_index("path", "/", -1).alias("name"),
        F.when(F.col("is_py"), "python").otherwise("javascript").alias("language"),
        (F.col("p_size") * 10 + F.coalesce("n_edges", F.lit(0)) + extra + 1).alias("lines_of_code"),
    )
    src = base.select("project_id", F.col("p").alias("a"), F.col("path").alias("source"))
    dst = base.select("project_id", F.col("p").alias("b"), F.col("path").alias("target"))
    edges = (
        pairs.join(src, ["project_id", "a"]).join(dst, ["project_id", "b"])
        .select("project_id", "source", "target", F.lit("import").alias("type"),
                F.array(F.concat(F.lit("s"), F.col("b").cast("string"))).alias("symbols"))
    )
    return nodes, edges


def known(spark: SparkSession, sf_dir: str, aliased: bool = False) -> DataFrame:
    """(project_id, path) of every corpus file, without generating any text."""
    out = parts(spark, sf_dir).select("project_id", "path")
    return out.unionByName(configs(spark, sf_dir).select("project_id", "path")) if aliased else out


def messy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of one awkward path per part, for the scan rules (no text)."""
    p = F.col("p_partkey").cast("string")
    k = F.col("p_partkey") % 9
    text = lambda *bits: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in bits])
    path = (
        F.when(k == 0, text("node_modules/pkg/m", p, ".js")).when(k == 1, text("src/.hidden/m", p, ".ts"))
        .when(k == 2, text("src/build/m", p, ".py")).when(k == 3, text("src/m", p, ".JS"))
        .when(k == 4, text("src/m", p, ".d.ts")).when(k == 5, text("docs/m", p, ".md"))
        .when(k == 6, text("src/__tests__/_m", p, ".py")).when(k == 7, text(".m", p, ".js"))
        .otherwise(text("src/p", p, "/.js"))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("project_id"), path.alias("path"),
        (F.col("p_size").cast("bigint") * 60000).alias("size_bytes"),
        (F.col("p_partkey") % 11 == 0).alias("is_symlink"), F.lit(None).cast("string").alias("content"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throttle input: bucket = event type, client = user."""
    micros = F.unix_micros(F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("bucket"), F.col("user_id").cast("string").alias("client"),
        F.col("event_id").alias("hit_id"), micros.alias("ts_us"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive listings: one archive per event type, entries in event order."""
    i, n = F.col("event_id"), F.col("event_id").cast("string")
    k = i % 6
    text = lambda *bits: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in bits])
    name = (
        F.when((i % 2999 == 1500) & (F.col("event_type") == "error"), text("top/../../m", n, ".py"))
        .when(k == 0, text("top/src/m", n, ".py")).when(k == 1, text("top/node_modules/m", n, ".js"))
        .when(k == 2, text("top/docs/m", n, ".md")).when(k == 3, text("top/pkg", n, "/tsconfig.json"))
        .when(k == 4, text("top/.github/m", n, ".py")).otherwise(text("top/m", n, ".tsx"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("archive"), i.alias("seq"), name.alias("name"),
        ((i * 7919) % 2300000).alias("size"),
        F.when(i % 13 == 0, "symlink").otherwise("file").alias("type"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored analysis per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("snapshot_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.col("o_orderpriority").startswith("1").alias("is_private"),
        F.col("o_custkey").cast("string").alias("owner"),
    )


def cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache rows: every event stores a snapshot under a key of its user and type."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("cache_key"),
        (F.col("event_id") * 2).cast("string").alias("snapshot_id"),
        F.col("ts").cast("timestamp_ntz").alias("cached_at"), F.col("event_id").alias("seq"),
    )
