"""Source trees of many projects as the ``files`` table.

Spark's file readers skip names that start with ``_`` or ``.``, and those
matter here (``__init__.py``, ``__tests__``). Folders are listed by tasks first: a task walks a folder
until it has seen a given number of them and hands back those it did not open, which other tasks take up in
the next round. Texts are read afterwards, in partitions of about equal size. Roots must be on storage every
executor mounts.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.functions import paths
from weftgraph.operators import scan
from weftgraph.session import cut_measure

# Only text the analysis can use is read: sources and JSON/vite configs, and below ignored folders the configs that others may extend.
READ_NAME = r"\.(?:jsx?|tsx?|py|json|[mc][jt]s)$"
PARENT_NAME = r"^[tj]sconfig[^/]*\.json$"
PART_BYTES = 64 << 20
FOLDERS = 2_000  # that a task opens below each folder it is given
ROWS, BATCH_BYTES = 10_000, 8 << 20

LISTING = "project_id string, root string, path string, size_bytes bigint, is_symlink boolean, is_folder boolean"


def _is_read(max_bytes: int | None) -> Column:
    path = F.col("path")
    fits = F.lit(True) if max_bytes is None else F.col("size_bytes") <= max_bytes
    return ~F.col("is_symlink") & fits & path.rlike(READ_NAME) & (
        ~scan.in_ignored_dir(path) | paths.basename(path).rlike(PARENT_NAME))


def _entries(root: str, folder: str, open_folders: deque) -> Iterator[tuple]:
    """(path, size, is_symlink) of the files of one folder; its folders are added to ``open_folders``."""
    top = os.path.join(root, folder)
    if not folder and not os.path.exists(top):
        raise FileNotFoundError(f"path does not exist: {root}")
    if not folder and not os.path.isdir(top):
        raise NotADirectoryError(f"path is not a directory: {root}")
    try:
        entries = list(os.scandir(top))
    except OSError:
        return
    for entry in sorted(entries, key=lambda e: e.name):
        path = f"{folder}/{entry.name}" if folder else entry.name
        if entry.is_dir(follow_symlinks=False):
            open_folders.append(path)
        elif not entry.is_dir():
            try:
                yield path, entry.stat().st_size, entry.is_symlink()
            except OSError:
                continue


def _walk(budget: int):
    def listed(batches):
        rows: list[tuple] = []

        def batch():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["project_id", "root", "path", "size_bytes", "is_symlink", "is_folder"])

        for given in batches:
            for row in given.to_pylist():
                project, root = row["project_id"], row["root"]
                waiting, opened = deque([row["path"]]), 0
                while waiting and opened < budget:
                    opened += 1
                    for path, size, link in _entries(root, waiting.popleft(), waiting):
                        rows.append((project, root, path, size, link, False))
                        if len(rows) >= ROWS:
                            yield batch()
                rows += [(project, root, path, None, False, True) for path in waiting]
                if len(rows) >= ROWS:
                    yield batch()
        if rows:
            yield batch()

    return listed


def list_trees(
    spark: SparkSession, roots: dict[str, str], max_bytes: int | None, folders: int = FOLDERS,
) -> tuple[DataFrame, int]:
    """(project_id, root, path, size_bytes, is_symlink, is_read) of every file, and the bytes to be read.

    Links to folders are not followed, folders and files that cannot be looked at are left out; a root that is missing
    or no directory is an error.
    """
    given = spark.createDataFrame([(p, r, "") for p, r in roots.items()], "project_id string, root string, path string")
    steps, to_read, waiting = [], 0, len(roots)
    while waiting:
        step, seen = cut_measure(
            given.repartition(waiting if waiting < 1_000 else 1_000 + waiting // 100, "project_id", "path")
            .mapInArrow(_walk(folders), LISTING).withColumn("is_read", F.coalesce(_is_read(max_bytes), F.lit(False))),
            folders=F.count_if("is_folder"), to_read=F.sum(F.when(F.col("is_read"), F.col("size_bytes"))),
        )
        steps.append(step.where(~F.col("is_folder")).drop("is_folder"))
        given = step.where("is_folder").select("project_id", "root", "path")
        waiting, to_read = seen["folders"], to_read + (seen["to_read"] or 0)
    empty = spark.createDataFrame([], LISTING + ", is_read boolean").drop("is_folder")
    return reduce(DataFrame.unionByName, steps, empty), to_read


def _text(full: str) -> str | None:
    try:
        with open(full, encoding="utf-8", newline="") as handle:
            return handle.read()
    except (OSError, UnicodeDecodeError):
        return None


def _with_text(batches):
    for batch in batches:
        held, begin, texts = 0, 0, []
        for i, (root, path, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("root", "path", "size_bytes")), strict=True)):
            texts.append(_text(os.path.join(root, path)))
            held += size
            if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                rows = batch.slice(begin, i + 1 - begin)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("project_id", "path", "size_bytes", "is_symlink")), pa.array(texts, pa.string())],
                    ["project_id", "path", "size_bytes", "is_symlink", "content"])
                held, begin, texts = 0, i + 1, []


def read_trees(
    spark: SparkSession, roots: dict[str, str], max_bytes: int | None = scan.MAX_FILE_BYTES,
    part_bytes: int = PART_BYTES, folders: int = FOLDERS,
) -> DataFrame:
    """``files`` of several projects: {project_id: root directory}.

    Folders are listed at once, texts are read when the table is used. Symlinks, files above ``max_bytes``, other kinds of
    files and sources below ignored folders have a row with null content, as has text that is not UTF-8.
    """
    listing, to_read = list_trees(spark, roots, max_bytes, folders)
    columns = ["project_id", "path", "size_bytes", "is_symlink"]
    read = (
        listing.where("is_read").repartition(max(1, -(-to_read // part_bytes)), "project_id", "path")
        .mapInArrow(_with_text, schema.FILES)
    )
    rest = listing.where(~F.col("is_read")).select(*columns, F.lit(None).cast("string").alias("content"))
    return read.unionByName(rest)
