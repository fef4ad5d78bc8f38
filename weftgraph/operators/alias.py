"""Path aliases from tsconfig/jsconfig and vite configs, as rule tables and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftgraph.functions import paths
from weftgraph.operators import scan
from weftgraph.session import cut, cut_count, cut_measure

# Fixed values the results depend on.
TS_NAMES = ("tsconfig.json", "tsconfig.app.json", "tsconfig.base.json", "jsconfig.json")
VITE_NAMES = tuple(f"vite.config.{e}" for e in ("ts", "js", "mjs", "cjs", "mts", "cts"))
MAX_EXTENDS = 8
MAX_CONFIG_BYTES = 1024 * 1024

JSON_NAME = r"(?i)\.json[c5]?$"

OUTSIDE = "//"  # stands for any path that has left the project
KEY = "project_id"

_EVEN = r"(?<!(?<!\\)(?:\\\\){0,10}\\%s)"
_JSON_STRING = '(?>"[^\\n]*?"' + _EVEN % '"' + ")"
_JS_STRING = "(?>" + "|".join(f"{q}[^\\n]*?{q}" + _EVEN % q for q in ('"', "'")) + r"|`[\s\S]*?`)"
_COMMENT = r"/\*[\s\S]*?(?:\*/|\z)|//[^\r\n]*+"


def _inside_join(base: Column, rel: Column) -> Column:
    joined = F.coalesce(paths.normalize(paths.join(base, rel)), F.lit(OUTSIDE))
    return F.when((base == OUTSIDE) | rel.startswith("/"), F.lit(OUTSIDE)).otherwise(joined)


def strip_json_comments(text: Column) -> Column:
    """JSONC to JSON: byte-order mark, comments and trailing commas go; strings stay."""
    plain = F.regexp_replace(F.regexp_replace(text, r"^\ufeff", ""), rf"({_JSON_STRING})|{_COMMENT}", "$1")
    return F.regexp_replace(plain, rf"({_JSON_STRING})|,(?=[ \t\r\n]*[}}\]])", "$1")


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _ts_options(text: Column) -> Column:
    """(base_url, paths, extends) of one config text; NULL fields where absent."""
    clean = strip_json_comments(text)
    doc = F.try_parse_json(clean)
    base = F.try_variant_get(doc, "$.compilerOptions.baseUrl", "variant")
    raw = F.try_variant_get(doc, "$.compilerOptions.paths", "map<string,variant>")
    ext = F.try_variant_get(doc, "$.extends", "variant")
    ext_list = F.try_variant_get(ext, "$", "array<variant>")
    listed = F.substr(clean, F.greatest(F.instr(clean, F.lit('"paths"')), F.lit(1)))  # keys keep the order they are written in
    strings = lambda a: F.transform(
        F.filter(a, _is_string), lambda v: F.variant_get(v, "$", "string")
    )
    entries = F.transform(
        F.map_entries(raw),
        lambda e: F.struct(
            e["key"].alias("pattern"),
            F.regexp_instr(listed, F.concat(F.lit('\\Q"'), e["key"], F.lit('"\\E\\s*:'))).alias("pos"),
            strings(F.try_variant_get(e["value"], "$", "array<variant>")).alias("targets"),
        ),
    )
    return F.struct(
        F.when(_is_string(base), F.try_variant_get(base, "$", "string")).alias("base_url"),
        F.filter(entries, lambda e: e["targets"].isNotNull()).alias("paths"),
        F.when(_is_string(ext), F.array(F.try_variant_get(ext, "$", "string")))
        .otherwise(F.transform(ext_list, lambda v: F.when(_is_string(v), F.try_variant_get(v, "$", "string"))))
        .alias("extends"),
    )


def _readable(max_bytes: int | None) -> Column:
    fits = F.lit(True) if max_bytes is None else F.col("size_bytes") <= max_bytes
    return ~F.col("is_symlink") & fits & F.col("content").isNotNull()


def carried(max_bytes: int | None = MAX_CONFIG_BYTES) -> Column:
    """Whether a file's text is kept for the rules while the sources are read.

    These are the vite configs, and JSON files that say anything the rules use; a parent config under another kind of name
    is read when a config refers to it.
    """
    name = paths.basename(F.col("path"))
    says = F.contains("content", F.lit("extends")) | F.contains("content", F.lit("compilerOptions"))
    return _readable(max_bytes) & (name.isin(*VITE_NAMES) | (name.rlike(JSON_NAME) & says))


def config_texts(files: DataFrame, max_bytes: int | None = MAX_CONFIG_BYTES) -> DataFrame:
    """(project_id, path, content) of the files that ``carried`` names."""
    return files.where(carried(max_bytes)).select(KEY, "path", "content")


def ts_options(
    files: DataFrame, configs: DataFrame | None = None,
    max_bytes: int | None = MAX_CONFIG_BYTES, max_extends: int | None = MAX_EXTENDS,
) -> DataFrame:
    """Effective (base_url, paths) of every ts/js config, ``extends`` followed.

    A chain is a list of reference positions; own settings beat inherited ones
    and a later reference beats an earlier one, which is the order of the
    negated position lists. ``max_bytes`` and ``max_extends`` are the service's
    limits; None lifts them, and a chain ends where it would meet itself.
    """
    configs = config_texts(files, max_bytes) if configs is None else configs
    head = [KEY, "config", "path", "chain", "visited"]
    options = lambda df: df.select(*head, _ts_options(F.col("content")).alias("o")).select(*head, "o.*")
    found = loaded = cut(options(
        configs.where(
            paths.basename(F.col("path")).isin(*TS_NAMES) & ~scan.in_ignored_dir(F.col("path"))
        ).select(
            KEY, F.col("path").alias("config"), "path", "content",
            F.array().cast("array<int>").alias("chain"), F.array("path").alias("visited"),
        )
    ))
    depth = 0
    while max_extends is None or depth < max_extends:
        depth += 1
        ref = _inside_join(paths.dirname(F.col("path")), F.col("ref"))
        refs, n = cut_count(
            loaded.select(KEY, "config", "path", "chain", "visited", F.posexplode("extends").alias("i", "ref"))
            .where(F.startswith("ref", F.lit(".")))
            .withColumn("chain", F.array_append("chain", -F.col("i")))
            .select(KEY, "config", "chain", "visited",
                    F.posexplode(F.array(ref, F.concat(ref, F.lit(".json")))).alias("rank", "parent"))
        )
        if not n:
            break
        parents, seen = cut_measure(
            refs.join(files.select(KEY, F.col("path").alias("parent")), [KEY, "parent"])
            .groupBy(KEY, "config", "chain", "visited")
            .agg(F.min_by("parent", "rank").alias("path"))
            .where(~F.array_contains("visited", F.col("path"))),
            unusual=F.count_if(~paths.basename(F.col("path")).rlike(JSON_NAME)),
        )
        # the corpus is read again only for a parent whose name does not look like JSON
        texts = files.where(_readable(max_bytes)).select(KEY, "path", "content") if seen["unusual"] else configs
        loaded = cut(options(
            parents.join(texts, [KEY, "path"]).withColumn("visited", F.array_append("visited", F.col("path")))
        ))
        found = found.unionByName(loaded)
    directory = paths.dirname(F.col("path"))
    own_base = F.when(F.col("base_url").isNotNull(), _inside_join(directory, F.col("base_url")))
    return found.groupBy(KEY, "config").agg(
        F.min_by(own_base, F.when(F.col("base_url").isNotNull(), F.col("chain"))).alias("base_url"),
        F.min_by(
            F.struct("paths", directory.alias("dir")), F.when(F.col("paths").isNotNull(), F.col("chain"))
        ).alias("p"),
    ).select(KEY, "config", "base_url", "p.paths", F.col("p.dir").alias("paths_dir"))


# --- vite --------------------------------------------------------------------
# A path expression is read as tokens: strings, dotted names (an empty call belongs to its name), and single signs.
_TOKEN = r"('[^']*'|\"[^\"]*\"|[A-Za-z_$][\w$.]*(?:\(\))?|\S)"
_HERE, _ROOT = "__dirname", "process.cwd()"
_VALUE = r"(?:[^,(){}\[\]'\"`]++|\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)|'[^']*+'|\"[^\"]*+\")++"
_KEY_NAME = r"(?:'[^']*+'|\"[^\"]*+\"|[A-Za-z_$][\w$\-]*+)"


def _eval_target(expr: Column, directory: Column) -> Column:
    """The path that an alias value names, found without executing it; NULL for any other value.

    The innermost call is split into its name and arguments, and these are judged: ``resolve`` or ``join`` of strings after
    an optional base folder, ``URL`` of a string and the module's address, a string added to the folder of the
    config, and, where nothing is called, a string alone.
    """
    quoted = lambda t: t.rlike(r"^['\"]")
    bare = lambda t: F.substr(t, F.lit(2), F.length(t) - 2)
    below = lambda t: _inside_join(directory, F.regexp_replace(bare(t), r"^[/\\]+", ""))

    def judged(call: Column) -> Column:
        name, args = F.substring_index(call["name"], ".", -1), call["args"]
        first, second, third = (F.get(args, F.lit(i)) for i in range(3))
        based = F.coalesce(first.isin(_HERE, _ROOT), F.lit(False))
        strings = F.filter(args, quoted)
        only_strings = F.size(strings) + based.cast("int") == F.size(args)
        joined = F.when(F.exists(strings, lambda t: bare(t).startswith("/")), F.lit(OUTSIDE)).otherwise(
            _inside_join(directory, F.array_join(F.transform(strings, bare), "/")))
        return (
            F.when(name.isin("resolve", "join") & only_strings & ((F.size(strings) > 0) | (first == _HERE)), joined)
            .when((name == "URL") & quoted(first) & (second == "import.meta.url"), _inside_join(directory, bare(first)))
            .when((first == _HERE) & (second == "+") & quoted(third), below(third))
            .when(name.isNull() & (F.size(args) == 1) & quoted(first), below(first))
        )

    def split(tokens: Column) -> Column:
        from_end = F.array_position(F.reverse(tokens), "(").cast("int")
        at = F.when(from_end > 0, F.size(tokens) - from_end + 1).otherwise(0)  # the last bracket that opens, counted from 1
        inside = F.slice(tokens, at + 1, F.size(tokens))
        end = F.array_position(inside, ")").cast("int")
        body = F.when(end > 0, F.slice(inside, F.lit(1), end - 1)).otherwise(inside)
        return F.struct(
            F.when(at > 0, F.coalesce(F.get(tokens, at - 2), F.lit(""))).alias("name"),
            F.filter(body, lambda t: t != ",").alias("args"),
        )

    tokens = F.regexp_extract_all(expr, F.lit(_TOKEN), F.lit(1))
    calls = F.transform(F.array(tokens), split)  # one element, so that each step is computed once
    return F.transform(calls, judged)[0]


def vite_aliases(configs: DataFrame) -> DataFrame:
    """(project_id, dir, file_order, pos, key, target) from ``resolve.alias``, never executed."""
    name = paths.basename(F.col("path"))
    text = F.regexp_replace("content", rf"({_JS_STRING})|{_COMMENT}", "$1")
    base = configs.where(name.isin(*VITE_NAMES) & ~scan.in_ignored_dir(F.col("path"))).select(
        KEY, paths.dirname(F.col("path")).alias("dir"),
        F.array_position(F.array(*[F.lit(n) for n in VITE_NAMES]), name).cast("int").alias("file_order"),
        text.alias("text"),
    )
    objects = F.flatten(F.transform(
        F.regexp_extract_all("text", F.lit(r"\balias\s*:\s*\{([^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+)\}"), F.lit(1)),
        lambda b: F.transform(
            F.regexp_extract_all(b, F.lit(rf"({_KEY_NAME}\s*:\s*{_VALUE})"), F.lit(1)),
            lambda e: F.struct(
                F.regexp_extract(e, rf"(?s)^({_KEY_NAME})\s*:\s*(.+)$", 1).alias("key"),
                F.regexp_extract(e, rf"(?s)^({_KEY_NAME})\s*:\s*(.+)$", 2).alias("expr"),
            ),
        ),
    ))
    lists = F.flatten(F.transform(
        F.regexp_extract_all("text", F.lit(r"\balias\s*:\s*\[([^\[\]]*+(?:\[[^\[\]]*+\][^\[\]]*+)*+)\]"), F.lit(1)),
        lambda b: F.transform(
            F.regexp_extract_all(b, F.lit(r"\{([^{}]*+)\}"), F.lit(1)),
            lambda e: F.struct(
                F.regexp_extract(e, r"\bfind\s*:\s*((['\"]).*?\2)", 1).alias("key"),
                F.regexp_extract(e, rf"(?:^|,)\s*replacement\s*:\s*({_VALUE})", 1).alias("expr"),
            ),
        ),
    ))
    return (
        base.select(KEY, "dir", "file_order", F.posexplode(F.concat(objects, lists)).alias("pos", "e"))
        .select(
            KEY, "dir", "file_order", "pos",
            F.regexp_replace("e.key", r"^['\"]|['\"]$", "").alias("key"),
            _eval_target(F.trim("e.expr"), F.col("dir")).alias("target"),
        )
        .where((F.col("key") != "") & F.col("target").isNotNull())
    )


# --- rules -------------------------------------------------------------------

def _target_is_local(t: Column) -> Column:
    bare = F.replace(t, F.lit("*"), F.lit(""))
    return (t != OUTSIDE) & ~F.array_contains(F.split(bare, "/"), "node_modules")


def rules(
    files: DataFrame, configs: DataFrame | None = None,
    max_bytes: int | None = MAX_CONFIG_BYTES, max_extends: int | None = MAX_EXTENDS,
) -> DataFrame:
    """Compiled rules per directory, in the order they are tried.

    ``mode`` is paths, vite or base; a base row carries the directory's
    ``baseUrl`` as its only target and ranks after all rules. ``configs`` are
    the ``config_texts`` of ``files`` where they have been read already.
    """
    configs = config_texts(files, max_bytes) if configs is None else configs
    opts = ts_options(files, configs, max_bytes, max_extends).select(
        KEY, paths.dirname(F.col("config")).alias("dir"),
        F.array_position(
            F.array(*[F.lit(n) for n in TS_NAMES]), paths.basename(F.col("config"))
        ).cast("int").alias("file_order"),
        "base_url", "paths", "paths_dir",
    )
    star = F.instr("e.pattern", F.lit("*"))
    anchor = F.coalesce("base_url", "paths_dir")
    ts = opts.select("*", F.explode("paths").alias("e")).where(
        (F.size(F.split("e.pattern", r"\*")) <= 2) & (F.size("e.targets") > 0)
    ).select(
        KEY, "dir", F.lit("paths").alias("mode"), "file_order", F.col("e.pos").cast("int").alias("pos"),
        F.when(star > 0, F.substring_index("e.pattern", "*", 1)).otherwise(F.col("e.pattern")).alias("prefix"),
        F.when(star > 0, F.substring_index("e.pattern", "*", -1)).otherwise("").alias("suffix"),
        (star > 0).alias("wildcard"),
        F.transform("e.targets", lambda t: _inside_join(anchor, t)).alias("targets"),
    )
    vite = vite_aliases(configs).select(
        KEY, "dir", F.lit("vite").alias("mode"), "file_order", "pos", F.col("key").alias("prefix"),
        F.lit("").alias("suffix"), F.lit(False).alias("wildcard"), F.array("target").alias("targets"),
    )
    base = opts.where(F.col("base_url").isNotNull()).groupBy(KEY, "dir").agg(
        F.min_by("base_url", "file_order").alias("b")
    ).select(
        KEY, "dir", F.lit("base").alias("mode"), F.lit(0).alias("file_order"), F.lit(0).alias("pos"),
        F.lit("").alias("prefix"), F.lit("").alias("suffix"), F.lit(True).alias("wildcard"),
        F.array("b").alias("targets"),
    )
    mode_rank = F.when(F.col("mode") == "paths", 0).when(F.col("mode") == "vite", 1).otherwise(2)
    # One window group holds the rules of one directory's few config files.
    w = Window.partitionBy(KEY, "dir").orderBy(
        mode_rank, "wildcard", -F.length("prefix"), "file_order", "pos", "prefix", "suffix"
    )
    return ts.unionByName(vite).unionByName(base).select(
        KEY, "dir", F.row_number().over(w).alias("rule_rank"), "mode", "prefix", "suffix", "wildcard",
        "targets", F.forall("targets", _target_is_local).alias("is_local"),
    )


def _forms(rule_table: DataFrame) -> DataFrame:
    """Rules keyed by the literal a specifier must equal (exact) or start with."""
    key = F.regexp_replace("prefix", r"/+$", "")
    form = lambda exact, lit: F.struct(F.lit(exact).alias("exact"), lit.alias("lit"))
    made = (
        F.when(F.col("mode") == "vite", F.array(form(True, key), form(False, F.concat(key, F.lit("/")))))
        .when(F.col("wildcard"), F.array(form(False, F.col("prefix"))))
        .otherwise(F.array(form(True, F.col("prefix"))))
    )
    return rule_table.select("*", F.explode(made).alias("f")).select(
        KEY, F.col("dir").alias("at"), "rule_rank", "mode", "prefix", "suffix", "targets", "is_local",
        "f.exact", "f.lit",
    )


def resolve_external(external: DataFrame, rule_table: DataFrame | None, targets: DataFrame) -> DataFrame:
    """Adds ``target`` and ``kind`` to external-looking JS imports.

    Each distinct (importing directory, specifier) is matched once, nearest
    config first. Rules are found by an equi-join on the literal a specifier
    starts with, so a directory's imports never meet all of its rules.
    """
    spec = F.col("spec")
    asked = external.withColumn("at_dir", paths.dirname(F.col("path"))).withColumn(
        "spec", F.trim("specifier")
    )
    wanted = (
        asked.where((spec != "") & ~spec.startswith("node:"))
        .select(KEY, "at_dir", "spec").distinct()
    )
    up = wanted.select("*", F.posexplode(paths.ancestors(F.col("at_dir"))).alias("dist", "at"))
    rank = lambda late, rule, idx: F.struct(
        F.lit(late).alias("late"), F.col("dist").alias("dist"), rule.alias("rule"), idx.alias("idx")
    )
    fallback = up.where(spec.startswith("@/")).select(
        KEY, "at_dir", "spec", rank(1, F.lit(0), F.lit(0)).alias("rank"),
        paths.join(F.col("at"), F.lit("src"), F.substr("spec", F.lit(3))).alias("base"),
        F.lit(False).alias("local_rule"),
    )
    candidates = fallback
    if rule_table is not None:
        forms = _forms(rule_table)
        # -1 stands for "the whole specifier"; lengths of one directory's prefixes are few.
        probe = F.when(F.col("exact"), F.lit(-1)).otherwise(F.length("lit"))
        lengths = forms.groupBy(KEY, "at").agg(F.collect_set(probe).alias("lens"))
        hit = (
            up.join(lengths, [KEY, "at"])
            .select(KEY, "at_dir", "spec", "dist", "at", F.explode("lens").alias("len"))
            .where(F.col("len") <= F.length("spec"))
            .withColumn("exact", F.col("len") == -1)
            .withColumn("lit", F.when(F.col("exact"), spec).otherwise(F.substr("spec", F.lit(1), F.col("len"))))
            .join(forms, [KEY, "at", "exact", "lit"])
        )
        suffix_ok = F.endswith("spec", F.col("suffix")) & (
            F.length("spec") >= F.length("lit") + F.length("suffix")
        )
        rest = F.when(
            F.col("exact"), F.lit(None)
        ).otherwise(F.substr(
            "spec", F.length("lit") + 1, F.length("spec") - F.length("lit") - F.length("suffix")
        ))
        expanded = (
            F.when(F.col("exact"), F.col("t"))
            .when(F.col("mode") == "paths", F.replace(F.col("t"), F.lit("*"), F.col("rest")))
            .otherwise(F.concat_ws("/", F.when(F.col("t") != "", F.col("t")), F.col("rest")))
        )
        ruled = (
            hit.where(F.col("exact") | suffix_ok).withColumn("rest", rest)
            .select("*", F.posexplode("targets").alias("idx", "t"))
            .select(
                KEY, "at_dir", "spec", rank(0, F.col("rule_rank"), F.col("idx")).alias("rank"),
                F.when(F.col("t") != OUTSIDE, paths.normalize(expanded)).alias("base"),
                (F.col("is_local") & (F.col("prefix") != "") & (F.col("mode") != "base")).alias("local_rule"),
            )
        )
        candidates = candidates.unionByName(ruled)
    outcome = (
        candidates.withColumn("base", paths.normalize(F.col("base")))
        .join(targets, [KEY, "base"], "left")
        .groupBy(KEY, "at_dir", "spec")
        .agg(
            F.min_by("target", F.when(F.col("target").isNotNull(), F.col("rank"))).alias("target"),
            F.max("local_rule").alias("local_rule"),
        )
    )
    kind = (
        F.when(F.col("target").isNotNull(), "local")
        .when(spec.startswith("@/") | F.coalesce("local_rule", F.lit(False)), "unresolved")
        .otherwise("external")
    )
    return asked.join(outcome, [KEY, "at_dir", "spec"], "left").withColumn("kind", kind).select(
        *external.columns, "target", "kind"
    )
