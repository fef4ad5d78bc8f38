"""Session helpers: where lineage is cut, and how.

Iterative operators cut lineage with tables written to the shared folder, so a lost
executor costs a re-read of the shared folder and never the whole loop.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only on local masters."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="weftgraph-")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for a written intermediate table."""
    path = f"{shared_dir(spark).rstrip('/')}/weftgraph/{label}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    return path


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """The list of scratch paths made inside, to be given to ``drop_scratch`` when nothing reads them any more."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes[:] = [s for s in _scopes if s is not made]


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables through the file system that holds them; only paths that ``scratch_path`` made are accepted."""
    base = f"{shared_dir(spark).rstrip('/')}/weftgraph/"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if not path.startswith(base):
            raise ValueError(f"not a scratch path: {path}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def spread(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides stay on the executors: in a loop, small tables broadcast in every round add up at the driver."""
    return left.join(right.hint("merge"), on, how)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    A written table (rather than ``checkpoint()``) also gives the next plan
    real sizes, so small loop states are broadcast only when they are small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_count(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` that also reports the row count, without a second job."""
    seen = Observation()
    done = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return done, seen.get["n"]


def cut_measure(df: DataFrame, **measures) -> tuple[DataFrame, dict]:
    """``cut`` that reports aggregate ``measures`` of the rows, without a second job."""
    seen = Observation()
    done = cut(df.observe(seen, *[c.alias(k) for k, c in measures.items()]))
    return done, seen.get
