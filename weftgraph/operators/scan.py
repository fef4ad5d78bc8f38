"""Scan operators: ignore rules, extension filter, size and project ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import paths

# Fixed values the results depend on.
IGNORED_DIRS = (
    "node_modules", ".git", "dist", "build", "coverage", ".next", ".cache", "venv", "__pycache__",
)
SOURCE_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".py")
MAX_FILE_BYTES = 2 * 1024 * 1024
MAX_PROJECT_FILES = 20_000
CONFIG_NAME = (
    r"(?i)^(?:(?:tsconfig|jsconfig)[\w.\-]*\.json|vite\.config\.(?:js|ts|mjs|cjs|mts|cts))$"
)


def in_ignored_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.exists(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda d: d.isin(*IGNORED_DIRS) | d.startswith("."),
    )


def scan_status(path: Column, size_bytes: Column, is_symlink: Column, max_bytes: int | None = MAX_FILE_BYTES) -> Column:
    """First rule that drops the file, or ``kept``; without ``max_bytes`` no size is too large."""
    oversized = F.lit(False) if max_bytes is None else size_bytes > max_bytes
    return (
        F.when(in_ignored_dir(path), "ignored_dir")
        .when(~paths.extension(path).isin(*SOURCE_EXTENSIONS), "extension")
        .when(is_symlink, "symlink")
        .when(oversized, "oversized")
        .otherwise("kept")
    )


def scan(files: DataFrame, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """``files`` with a ``scan_status`` column; nothing is removed."""
    return files.withColumn(
        "scan_status", scan_status(F.col("path"), F.col("size_bytes"), F.col("is_symlink"), max_bytes)
    )


def kept(files: DataFrame, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    return scan(files, max_bytes).where(F.col("scan_status") == "kept").drop("scan_status")


def rejected_projects(files: DataFrame, limit: int = MAX_PROJECT_FILES) -> DataFrame:
    """Projects whose kept files exceed the ceiling."""
    return (
        kept(files).groupBy("project_id").agg(F.count(F.lit(1)).alias("kept_files"))
        .where(F.col("kept_files") > limit)
    )


def admit_projects(files: DataFrame, limit: int = MAX_PROJECT_FILES) -> DataFrame:
    """Files of the projects under the ceiling; other projects go on when one is rejected."""
    return files.join(rejected_projects(files, limit), "project_id", "left_anti")


def config_files(files: DataFrame) -> DataFrame:
    """tsconfig/jsconfig/vite config files outside ignored directories."""
    return files.where(
        paths.basename(F.col("path")).rlike(CONFIG_NAME) & ~in_ignored_dir(F.col("path"))
    )


def language(path: Column) -> Column:
    return F.when(paths.extension(path) == ".py", "python").otherwise("javascript")
