"""Archive-manifest admission and repository addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import paths
from weftgraph.operators import scan

# Fixed values the results depend on.
MAX_ENTRIES = 200_000
MAX_UNPACKED_BYTES = 1024 ** 3
MAX_MEMBER_BYTES = 2 * 1024 * 1024
MAX_WANTED = 20_000
REPO_URL = (
    r"^https?://github\.com/([A-Za-z0-9][A-Za-z0-9-]{0,38})/([A-Za-z0-9._-]{1,100}?)(?:\.git)?"
    r"(?:/tree/([\w./-]{1,255}))?/?$"
)
REF_SEGMENT = r"^[A-Za-z0-9_][A-Za-z0-9._-]*$"

BLOCK = 65_536  # rows of one archive summed in one window group


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """Running totals along ``order`` (a unique number per key), safe for one huge key.

    A key's rows are cut into blocks of the order range; block totals are
    accumulated first and added to the totals within each block.
    """
    work = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    values = work.withColumns({f"_v_{k}": c for k, c in sums.items()})
    per_block = values.groupBy(*keys, "_block").agg(
        *[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums]
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys, "_block",
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    out = values.withColumns({f"_i_{k}": F.sum(f"_v_{k}").over(inside) for k in sums})
    out = out.join(offsets, [*keys, "_block"])
    return out.select(*df.columns, *[(F.col(f"_o_{k}") + F.col(f"_i_{k}")).alias(k) for k in sums])


def _unsafe(name: Column) -> Column:
    """The entry would land outside the extraction directory."""
    return name.startswith("/") | paths.normalize(name).isNull()


def wanted_member(name: Column, kind: Column) -> Column:
    """Regular source or config files outside ignored directories of the archive's top folder."""
    parts = F.split(name, "/")
    middle = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(
        F.array().cast("array<string>")
    )
    clear = ~F.exists(middle, lambda d: d.isin(*scan.IGNORED_DIRS) | d.startswith("."))
    base = paths.basename(name)
    return (kind == "file") & clear & (
        paths.extension(name).isin(*scan.SOURCE_EXTENSIONS) | base.rlike(scan.CONFIG_NAME)
    )


def admit(
    manifest: DataFrame, max_entries: int = MAX_ENTRIES, max_unpacked: int = MAX_UNPACKED_BYTES,
    max_wanted: int = MAX_WANTED,
) -> tuple[DataFrame, DataFrame]:
    """(wanted members of admitted archives, rejected(archive, reason, seq))."""
    take = wanted_member(F.col("name"), F.col("type")) & (F.col("size") <= MAX_MEMBER_BYTES)
    flagged = manifest.withColumns({"take": take, "unsafe": _unsafe(F.col("name"))})
    walked = running(flagged, ["archive"], "seq", {
        "entries": F.lit(1).cast("bigint"),
        "unpacked": F.greatest("size", F.lit(0)),
        "taken": F.col("take").cast("bigint"),
    })
    # Paths and budgets are checked on the first pass over an archive, members on the second.
    reason = (
        F.when(F.col("unsafe"), "unsafe_path")
        .when((F.col("entries") > max_entries) | (F.col("unpacked") > max_unpacked), "too_large")
        .when(F.col("take") & (F.col("taken") > max_wanted), "too_many_files")
    )
    late = (reason == "too_many_files").cast("int")
    rejected = (
        walked.withColumn("reason", reason).where(F.col("reason").isNotNull())
        .groupBy("archive").agg(F.min(F.struct(late.alias("late"), "seq", "reason")).alias("r"))
        .select("archive", "r.reason", "r.seq")
    )
    wanted = flagged.where("take").select("archive", "seq", "name", "size").join(
        rejected.select("archive"), "archive", "left_anti"
    )
    return wanted, rejected


def repo_address(url: Column) -> Column:
    """struct(owner, repo, ref, valid) of a repository URL."""
    text = F.regexp_replace(url, r"^\s+|\s+$", "")
    part = lambda i: F.regexp_extract(text, REPO_URL, i)
    repo, ref = part(2), part(3)
    segments = F.split(ref, "/")
    good_ref = (ref == "") | F.forall(segments, lambda s: s.rlike(REF_SEGMENT) & ~s.isin(".", ".."))
    valid = F.coalesce(
        text.rlike(REPO_URL) & ~repo.isin(".", "..") & ~repo.endswith(".lock") & good_ref, F.lit(False)
    )
    return F.struct(
        F.when(valid, part(1)).alias("owner"), F.when(valid, repo).alias("repo"),
        F.when(valid & (ref != ""), ref).alias("ref"), valid.alias("valid"),
    )
