"""Import extraction: Arrow batches of both languages through a scanner for JS/TS and ``ast`` for Python, in one pass over the text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import jssource, pysource
from weftgraph.functions.memory import give_back
from weftgraph.operators import scan

IMPORTS_TYPE = "array<struct<specifier:string,level:int,type:string,symbols:array<string>>>"

PARSED_TYPE = f"struct<error:string,imports:{IMPORTS_TYPE}>"


def js_parse(content: Column) -> Column:
    """Arrow batches of JS/TS text in, error and ordered import records out."""
    return F.pandas_udf(jssource.parse_batch, PARSED_TYPE)(content)


def python_parse(content: Column) -> Column:
    """Arrow batches of Python text in, error and ordered import records out."""
    return F.pandas_udf(pysource.parse_batch, PARSED_TYPE)(content)


PIECE = 256  # files of a batch that are held as Python strings and records at a time
RECORDS = pa.list_(pa.struct([
    ("specifier", pa.string()), ("level", pa.int32()), ("type", pa.string()), ("symbols", pa.list_(pa.string()))]))


def _parse_batches(batches):
    """(project_id, path, language, lines_of_code, content, more) in, error and imports in the place of content out."""
    parsers = {"javascript": jssource.parse_source, "python": pysource.parse_source}
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE):
            piece = batch.slice(start, PIECE)
            texts, langs = piece.column("content").to_pylist(), piece.column("language").to_pylist()
            rows = [parsers[x](text) if x else (None, None) for text, x in zip(texts, langs, strict=True)]
            at = len(HEAD)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:at], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], RECORDS),
                 *piece.columns[at + 1:]], names=[*piece.schema.names[:at], "error", "imports", *piece.schema.names[at + 1:]])
        give_back()


# --- per-file result ---------------------------------------------------------

def lines_of_code(content: Column, lang: Column) -> Column:
    """Newlines + 1; 0 for an unreadable file. Python text also counts a lone CR."""
    text = F.when(lang == "python", F.regexp_replace(content, r"\r\n?", "\n")).otherwise(content)
    count = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.coalesce(count, F.lit(0)).cast("int")


HEAD = ["project_id", "path", "language", "lines_of_code"]


def _parse(base: DataFrame, *more: str) -> DataFrame:
    """Adds line counts, error and imports to (project_id, path, language, content); rows without a language have none of them."""
    known = F.col("language").isNotNull()
    rows = base.withColumn("lines_of_code", F.when(known, lines_of_code(F.col("content"), F.col("language")))).select(
        *HEAD, F.when(known, F.col("content")).alias("content"), *more)
    fields = {f.name: f for f in rows.schema.fields}
    out = [*[fields[c] for c in HEAD], *T.StructType.fromDDL(f"error string, imports {IMPORTS_TYPE}").fields, *[fields[c] for c in more]]
    return rows.mapInArrow(_parse_batches, T.StructType(out))


def parse(files: DataFrame) -> DataFrame:
    """Kept files → (project_id, path, language, lines_of_code, error, imports)."""
    return _parse(files.select("project_id", "path", scan.language(F.col("path")).alias("language"), "content"))


def parse_beside(files: DataFrame, wanted: Column, max_bytes: int | None = scan.MAX_FILE_BYTES) -> DataFrame:
    """``parse`` of the kept ones of all ``files``, and the text of ``wanted`` ones as ``config_text``, from one reading.

    A wanted file that is no kept source has a null language, and a source that is not wanted a null text.
    """
    is_source = F.col("scan_status") == "kept"
    rows = scan.scan(files, max_bytes).withColumn("wanted", F.coalesce(wanted, F.lit(False))).where(is_source | F.col("wanted"))
    return _parse(rows.select(
        "project_id", "path", F.when(is_source, scan.language(F.col("path"))).alias("language"), "content",
        F.when(F.col("wanted"), F.col("content")).alias("config_text"),
    ), "config_text")


def imports(parsed: DataFrame) -> DataFrame:
    """One row per import record, numbered in source order within its file."""
    return parsed.select(
        "project_id", "path", "language", F.posexplode("imports").alias("ordinal", "r")
    ).select("project_id", "path", "ordinal", "language", "r.*")


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select(
        "project_id", F.col("path").alias("file"), "error"
    )
