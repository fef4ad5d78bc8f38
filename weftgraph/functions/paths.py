"""Path algebra as column expressions. Paths are root-relative with '/' separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Parent directory; the empty string for a file in the project root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Last suffix of the file name; leading dots do not start one."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def node_id(path: Column, root: Column | None = None) -> Column:
    """Root-relative, forward-slash form of a path."""
    slashed = F.regexp_replace(path, r"\\", "/")
    if root is not None:
        base = F.regexp_replace(F.regexp_replace(root, r"\\", "/"), r"/+$", "")
        slashed = F.when(
            F.startswith(slashed, F.concat(base, F.lit("/"))),
            F.substr(slashed, F.length(base) + 2),
        ).otherwise(slashed)
    return F.regexp_replace(slashed, r"^(?:\./)+", "")


def join(base: Column, *rest: Column) -> Column:
    """Plain join; an empty base adds no separator."""
    out = base
    for part in rest:
        out = F.when(out == "", part).otherwise(F.concat(out, F.lit("/"), part))
    return out


def normalize(path: Column) -> Column:
    """Collapse '.', '..' and empty segments. NULL when the path climbs above the root."""
    empty = F.array().cast("array<string>")

    def step(acc, seg):
        return (
            F.when(acc.isNull(), acc)
            .when(seg.isin("", "."), acc)
            .when(
                seg == "..",
                F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)),
            )
            .otherwise(F.array_append(acc, seg))
        )

    folded = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    plain = ~path.rlike(r"(^|/)\.{0,2}(/|$)")
    return F.when(plain, path).otherwise(folded)


def ancestors(directory: Column) -> Column:
    """The directory itself, then each parent up to the root ('')."""
    parts = F.split(directory, "/")
    depth = F.when(directory == "", F.lit(0)).otherwise(F.size(parts))
    return F.transform(
        F.sequence(depth, F.lit(0), F.lit(-1)),
        lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"),
    )


def climb(directory: Column, steps: Column) -> Column:
    """``steps`` parents up; NULL when that leaves the project."""
    parts = F.split(directory, "/")
    depth = F.when(directory == "", F.lit(0)).otherwise(F.size(parts))
    return F.when(steps <= depth, F.array_join(F.slice(parts, F.lit(1), depth - steps), "/"))
