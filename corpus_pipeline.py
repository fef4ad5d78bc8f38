"""Documents to token files: five operators in a row, each over all that the one before kept."""

from __future__ import annotations

from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import jaccard, leaks, mix, quality, tokens
from weftgraph.llm.common import table
from weftgraph.llm.queries import tokenizer
from weftgraph.session import cut, drop_scratch, scratch_scope

USED = ("doc_id", "text", "lang", "source")
ORACLE_SQL = None  # perplexity, latent retrieval and tokenisation are beyond SQL; tests hold the rows against plain Python


_made: list[str] = []  # scratch tables of the stages called so far


def _stage(stage):
    """A stage in its scratch scope: what earlier stages wrote on the way is dropped first, unless ``docs`` still reads it.

    The result of a stage is therefore to be written before the next stage is called, as ``run`` does.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _made else []
        done = [path for path in _made if not any(path in f for f in read)]
        drop_scratch(spark, done)
        _made[:] = [path for path in _made if path not in done]
        with scratch_scope() as made:
            out = stage(spark, docs, sf_dir)
        _made.extend(made)
        return out

    return run_stage


def _apart(stage):
    """Columns that a stage does not use go through it under names of their own, so that none can clash."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in USED else f"_carried{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.withColumnsRenamed(names), sf_dir)
        return out.select(*[F.col(now).alias(c) for c, now in names.items()])

    return _stage(run_stage)


@_apart
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; a corpus without a table of labels is judged without them.

    Null and empty texts go. Repeated rows are judged each, so all of them stay or go. An empty table gives an empty one; extra columns
    go through, whatever their names, here and in the stages below.
    """
    try:
        labels = table(spark, sf_dir, "labels")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        labels = None
    return quality.verdicts(docs, labels=labels).where("kept")


@_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 similar sets of five-word shingles, the one with the smallest id stays.

    Documents without a word are linked with nothing and stay. Of rows with equal ids and texts one stays; a null id
    is larger than any other.
    """
    return jaccard.representatives(docs)


@_apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts stay, and an empty benchmark lets all stay."""
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


@_apart
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them: not at all, once or twice; repeated rows are documents of their own.

    A null source is a source; texts without a word have no size and are not taken.
    """
    return mix.repeated(docs)


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; (doc_id, start, n_tokens, ids_crc32) of every document in them, a null or empty text with its end id alone."""
    return tokens.token_files(docs, tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
