"""Explainable 0-100 risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values the results depend on.
DEPENDENTS_CAP, DEPENDENTS_CEILING = 40, 20
CENTRALITY_CAP = 20
LINES_CAP, LINES_CEILING = 20, 500
CYCLE_POINTS = 20
LEVELS = (("Low", 30), ("Medium", 60), ("High", 80), ("Critical", 100))


def _points(value: Column, cap: int) -> Column:
    """Half-even rounding, capped."""
    return F.least(F.lit(cap), F.rint(value).cast("int"))


def level(score: Column) -> Column:
    out = None
    for name, top in LEVELS[:-1]:
        out = F.when(score <= top, name) if out is None else out.when(score <= top, name)
    return out.otherwise(LEVELS[-1][0])


def with_risk(wide: DataFrame) -> DataFrame:
    """Adds score, level and reasons from in_degree, degree_centrality, lines_of_code, in_cycle."""
    dependents = _points(F.col("in_degree") / DEPENDENTS_CEILING * DEPENDENTS_CAP, DEPENDENTS_CAP)
    central = _points(F.col("degree_centrality") * CENTRALITY_CAP * 2, CENTRALITY_CAP)
    size = _points(F.col("lines_of_code") / LINES_CEILING * LINES_CAP, LINES_CAP)
    cycle = F.when(F.col("in_cycle"), CYCLE_POINTS).otherwise(0)
    reasons = F.array_compact(F.array(
        F.when(F.col("in_degree") > 0, F.format_string("%d files depend on this module", "in_degree")),
        F.when(central >= CENTRALITY_CAP // 2, "High centrality in the dependency graph"),
        F.when(F.col("lines_of_code") >= LINES_CEILING * 4 // 10, F.format_string("%d lines of code", "lines_of_code")),
        F.when(F.col("in_cycle"), "Part of a circular dependency"),
    ))
    return (
        wide.withColumn("score", F.least(F.lit(100), dependents + central + size + cycle))
        .withColumn("level", level(F.col("score"))).withColumn("reasons", reasons)
    )


def rank_of(level_name: Column) -> Column:
    """Low 0 … Critical 3; NULL for an unknown level."""
    return F.array_position(F.array(*[F.lit(n) for n, _ in LEVELS]), level_name) - 1


def at_or_above(wide: DataFrame, threshold: int) -> DataFrame:
    """The gate's offenders."""
    return wide.where(F.col("score") >= threshold)
