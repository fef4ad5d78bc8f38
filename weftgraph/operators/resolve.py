"""Import resolution as joins.

Instead of probing many candidate paths per import, the *file* side is turned
into a lookup table once: each file is listed under every extension-less base
it can answer for, with its rank, and the best file per (project, base) wins.
An import then needs a single equi-join on its normalised base, whatever the
number of candidate extensions.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators import alias

# Fixed values the results depend on: probing order of file endings.
JS_ENDINGS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".d.ts")


def is_local_specifier(specifier: Column) -> Column:
    return F.coalesce(F.trim(specifier).rlike(r"^[./]"), F.lit(False))


def classify(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JS imports split into (local, external-looking)."""
    local = is_local_specifier(F.col("specifier"))
    return imports.where(local), imports.where(~local)


def js_targets(files: DataFrame) -> DataFrame:
    """(project_id, base) → best file: exact name, then endings, then index files."""
    path = F.col("path")
    rules = [F.struct(path.alias("base"), F.lit(0).alias("rank"))]
    for i, end in enumerate(JS_ENDINGS):
        stem = F.substr(path, F.lit(1), F.length(path) - len(end))
        rules.append(F.when(path.endswith(end) & (stem != ""),
                            F.struct(stem.alias("base"), F.lit(1 + i).alias("rank"))))
        rules.append(F.when(paths.basename(path) == f"index{end}",
                            F.struct(paths.dirname(path).alias("base"), F.lit(20 + i).alias("rank"))))
    return _best(files, F.array_compact(F.array(*rules)))


def python_targets(files: DataFrame) -> DataFrame:
    """(project_id, base) → module file, else the package's ``__init__.py``."""
    path = F.col("path")
    stem = F.substr(path, F.lit(1), F.length(path) - 3)
    rules = F.array(
        F.when(stem != "", F.struct(stem.alias("base"), F.lit(0).alias("rank"))),
        F.when(paths.basename(path) == "__init__.py",
               F.struct(paths.dirname(path).alias("base"), F.lit(1).alias("rank"))),
    )
    return _best(files.where(path.endswith(".py")), F.array_compact(rules))


def _best(files: DataFrame, rules: Column) -> DataFrame:
    return (
        files.select("project_id", "path", F.explode(rules).alias("r"))
        .groupBy("project_id", F.col("r.base").alias("base"))
        .agg(F.min_by("path", "r.rank").alias("target"))
    )


def resolve_js_local(local: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``target`` (NULL = unresolved). Absolute specifiers leave the project."""
    base = F.when(
        ~F.trim("specifier").startswith("/"),
        paths.normalize(paths.join(paths.dirname(F.col("path")), F.trim("specifier"))),
    )
    return local.withColumn("base", base).join(targets, ["project_id", "base"], "left").drop("base")


def _package_init(targets_init: DataFrame) -> DataFrame:
    return targets_init.where(paths.basename(F.col("path")) == "__init__.py").select(
        "project_id", paths.dirname(F.col("path")).alias("package"), F.col("path").alias("init_path")
    )


def resolve_python(imports: DataFrame, files: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``target`` and ``kind`` (local / external / unresolved) to Python imports."""
    directory = paths.dirname(F.col("path"))
    module = F.replace(F.col("specifier"), F.lit("."), F.lit("/"))

    # relative: one base; bare-dot names may fall back to the package itself
    rel = imports.where(F.col("level") > 0).withColumn(
        "package", paths.climb(directory, F.col("level") - 1)
    )
    rel = rel.withColumn("base", paths.join(F.col("package"), module))
    rel = rel.join(targets, ["project_id", "base"], "left")
    bare = (F.size("symbols") == 1) & (F.element_at("symbols", 1) == "*")
    rel = rel.join(_package_init(files), ["project_id", "package"], "left").withColumn(
        "target",
        F.coalesce("target", F.when(bare & (F.col("init_path") != F.col("path")), F.col("init_path"))),
    )
    rel = rel.withColumn("kind", F.when(F.col("target").isNull(), "unresolved").otherwise("local"))

    # absolute: project root, root/src, then the importer's ancestors, nearest
    # first. Each distinct (directory, module) is looked up once.
    absolute = imports.where(F.col("level") == 0).withColumn("dir", directory)
    wanted = absolute.select("project_id", "dir", "specifier").distinct()
    fixed = F.array(F.lit(""), F.lit("src"))
    top = F.substring_index("specifier", ".", 1)
    roots = F.when(top.isin(*sorted(sys.stdlib_module_names)), fixed).otherwise(
        F.concat(fixed, paths.ancestors(F.col("dir")))
    )
    hits = (
        wanted.select("*", F.posexplode(roots).alias("rank", "root"))
        .withColumn("base", paths.join(F.col("root"), module))
        .join(targets, ["project_id", "base"])
        .groupBy("project_id", "dir", "specifier")
        .agg(F.min_by("target", "rank").alias("target"))
    )
    absolute = absolute.join(hits, ["project_id", "dir", "specifier"], "left").withColumn(
        "kind", F.when(F.col("target").isNull(), "external").otherwise("local")
    )
    cols = [*imports.columns, "target", "kind"]
    return rel.select(*cols).unionByName(absolute.select(*cols))


def resolve(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """All imports with ``target``, ``kind`` and ``merge_order``.

    ``files`` are all paths of the project, scanned or not: an import may land
    on a stylesheet or on a file in an ignored directory. ``aliases`` is the
    output of ``alias.rules``; without it no config-based alias applies.
    """
    known = files.select("project_id", "path")
    js = imports.where(F.col("language") == "javascript")
    local, external = classify(js)
    targets = js_targets(known)
    local = resolve_js_local(local, targets).withColumn(
        "kind", F.when(F.col("target").isNull(), "unresolved").otherwise("local")
    )
    external = alias.resolve_external(external, aliases, targets)
    py = resolve_python(
        imports.where(F.col("language") == "python"), known, python_targets(known)
    )
    # External-looking JS imports are merged into edges before the local ones.
    order = lambda late: F.struct(F.lit(late).alias("late"), F.col("ordinal").alias("ordinal"))
    return (
        external.withColumn("merge_order", order(0))
        .unionByName(local.withColumn("merge_order", order(1)))
        .unionByName(py.withColumn("merge_order", order(0)))
    )
