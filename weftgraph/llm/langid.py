"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every text is lower-cased, everything but letters becomes one space, and the 1- to 3-grams of its characters are hashed
into ``BUCKETS`` features. Spark counts the features of each language over all training rows; the counts make a
matrix of log probabilities of BUCKETS rows and a column per language, with a bound that does not depend on the number of
documents, which is broadcast. Scoring is numpy over slices of a batch: one sparse row of features per text against the matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import ODD, slices

BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
LANGUAGES = 4096  # more labels than this are refused, which bounds the matrix
SLICE = 1 << 20


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def features(texts: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of every n-gram, text of every n-gram, whether a text has a letter)."""
    strings = [(t or "").lower() for t in texts.to_pylist()]
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    chars = letters[np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)]
    owner = np.repeat(np.arange(len(strings)), lengths)
    letter = chars != 32
    keep = letter.copy()  # of a run of spaces one is kept
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
    chars, owner, letter = chars[keep].astype(np.uint64), owner[keep], letter[keep]
    has_letter = np.bincount(owner[letter], minlength=len(strings)) > 0
    found, owners = [], []
    rolled = np.zeros(len(chars), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolled = rolled[: len(chars) - n + 1] * np.uint64(0x110003) + chars[n - 1:] if n <= len(chars) else chars[:0]
        if n in GRAMS and len(rolled):
            whole = owner[: len(rolled)] == owner[n - 1:]
            spread = (rolled + np.uint64(n)) * ODD
            found.append((spread[whole] >> np.uint64(64 - 15)).astype(np.int64) % BUCKETS)
            owners.append(owner[: len(rolled)][whole])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has_letter
    return np.concatenate(found), np.concatenate(owners), has_letter


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities) from all rows of (text, lang); null labels are left out.

    The last row of the matrix holds the log priors, which are those of the rows. Without rows there are no languages.
    """
    known = labelled.where(F.col("lang").isNotNull()).select("text", "lang")

    def counted(batches):
        letters = _letters()
        held: dict = {}
        for batch in batches:
            for piece in slices(batch, most=SLICE):
                found, owner, _ = features(piece.column(0), letters)
                langs = piece.column(1).dictionary_encode()
                code = langs.indices.to_numpy()
                names = langs.dictionary.to_pylist()
                sums = np.bincount(code[owner] * np.int64(BUCKETS) + found, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                rows = np.bincount(code, minlength=len(names))
                for name, total, n in zip(names, sums, rows, strict=True):
                    mine = held.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    mine[:-1] += total
                    mine[-1] += n
        for name, total in held.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * len(used), pa.string()), "feature": used, "n": total[used]})

    counts = known.mapInArrow(counted, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    languages = sorted(r.lang for r in known.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    matrix = np.zeros((BUCKETS + 1, len(languages)))
    if languages:
        at = {name: i for i, name in enumerate(languages)}
        found = counts.toArrow()  # at most BUCKETS + 1 rows per language
        langs = found.column("lang").combine_chunks().dictionary_encode()
        column = np.array([at[x] for x in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()]
        matrix[found.column("feature").to_numpy(), column] = found.column("n").to_numpy()
        seen = matrix[:-1] + SMOOTHING
        matrix = np.vstack([np.log(seen / seen.sum(axis=0)), np.log(matrix[-1:] / matrix[-1].sum())])
    return languages, matrix


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score): the most probable language and its posterior probability.

    ``und`` with score 0 for a null text, a text without a letter, or an empty model. Of equal languages the first by name.
    Repeated rows are scored each. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def scored(batches):
        languages, matrix = shared.value
        letters = _letters()
        names = np.array([*languages, UNKNOWN], object)
        for batch in batches:
            for piece in slices(batch, most=SLICE):
                found, owner, has_letter = features(piece.column(1), letters)
                n, width = len(piece), len(languages)
                if width:
                    totals = np.stack([np.bincount(owner, matrix[:, k][found], n) for k in range(width)], 1) + matrix[-1]
                    best = totals.argmax(axis=1)
                    score = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
                    best[~has_letter], score[~has_letter] = width, 0.0
                else:
                    best, score = np.zeros(n, np.int64), np.zeros(n)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                    names=[key, "lang_pred", "score"])

    return docs.select(key, "text").mapInArrow(scored, f"`{key}` {kind}, lang_pred string, score double")


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether the checksum of the key's text puts a row aside."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))
