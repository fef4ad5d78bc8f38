import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weftgraph import schema  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]").appName("weftgraph-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "1000")  # plans name whole paths, however long the folder of a test
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_files(spark):
    """{path: text} → the files table of project 'p'."""

    def make(tree, project="p"):
        rows = [(project, path, len((text or "").encode()), False, text) for path, text in tree.items()]
        return spark.createDataFrame(rows, schema.FILES)

    return make


@pytest.fixture(scope="session")
def make_graph(spark):
    """(nodes, edges) of project 'p' from {node: lines} or a node list, and pairs."""

    def make(nodes, pairs, project="p"):
        lines = nodes if isinstance(nodes, dict) else dict.fromkeys(nodes, 10)
        n = spark.createDataFrame(
            [(project, k, k.split("/")[-1], "python" if k.endswith(".py") else "javascript", v)
             for k, v in lines.items()], schema.NODES)
        e = spark.createDataFrame([(project, a, b, "import", []) for a, b in pairs], schema.EDGES)
        return n, e

    return make


@pytest.fixture(scope="session")
def edge_set():
    return lambda df: {(r.source, r.target) for r in df.collect()}
