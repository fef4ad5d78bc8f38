"""Files in, graph out: the whole extraction and resolution plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import alias, extract, graph, resolve, scan
from weftgraph.session import cut


@dataclass
class Build:
    parsed: DataFrame
    resolved: DataFrame
    edges: DataFrame

    @property
    def nodes(self) -> DataFrame:
        return graph.nodes(self.parsed, self.edges)

    @property
    def external_deps(self) -> DataFrame:
        return graph.external_deps(self.resolved)

    @property
    def unresolved(self) -> DataFrame:
        return graph.unresolved(self.resolved)

    @property
    def parse_errors(self) -> DataFrame:
        return extract.parse_errors(self.parsed)


def build(
    files: DataFrame, known: DataFrame | None = None, with_aliases: bool = True,
    ceiling: int | None = None, max_bytes: int | None = scan.MAX_FILE_BYTES,
) -> Build:
    """Text is read once: one written table holds the parse rows and the texts of the configs, and imports are resolved once from it.

    ``known(project_id, path)`` lists every existing file, scanned or not; by
    default it is read off ``files``. ``ceiling`` applies the per-project file
    limit of the analysis service, and ``max_bytes`` its limit of a source file.
    """
    if ceiling is not None:
        files = scan.admit_projects(files, ceiling)
    known = files.select("project_id", "path") if known is None else known
    if with_aliases:
        table = cut(extract.parse_beside(files, alias.carried(), max_bytes))
        parsed = table.where(F.col("language").isNotNull()).drop("config_text")
        configs = table.where(F.col("config_text").isNotNull()).select("project_id", "path", F.col("config_text").alias("content"))
        rule_table = cut(alias.rules(files, configs))
    else:
        parsed, rule_table = cut(extract.parse(scan.kept(files, max_bytes))), None
    resolved = cut(resolve.resolve(extract.imports(parsed), known, rule_table))
    return Build(parsed, resolved, graph.edges(resolved))
