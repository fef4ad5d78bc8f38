"""Helpers shared by the operators: words on Arrow buffers, hashes, and naming."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.memory import give_back

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20  # text that one vectorised step looks at, whatever the batch holds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(*parts: Column) -> Column:
    """32 uniform bits of the parts' texts, the same in any SQL engine with md5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def added(df: DataFrame, fresh: list[str], computed: DataFrame, row: str = "row") -> DataFrame:
    """The struct ``row`` spelt out, followed by the ``fresh`` columns.

    An input column with the name of a fresh one is replaced by it.
    """
    kept = [f"{row}.`{c}`" for c in df.columns if c not in fresh]
    return computed.select(*kept, *fresh)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Runs of the batch's rows whose texts hold about ``most`` bytes, at least one row each.

    After the last one, memory that the work on the batch has freed goes back to the system.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    start, held = 0, 0
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts as one array, and where each text starts; a null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each text (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~breaks[data]
    step = inside[1:] != inside[:-1]
    # two texts that touch without white space are still two words
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    joined = np.unique(edge[inside[edge] & inside[edge + 1]])
    bounds = np.flatnonzero(step)
    starts = np.sort(np.concatenate([bounds[0::2], joined]))
    ends = np.sort(np.concatenate([bounds[1::2], joined]))
    return starts, ends, np.searchsorted(starts, offsets)


ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


POWERS = 1 << 21  # powers of a base that a worker keeps; a longer text has its own made
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The powers of ``base`` from 0 to ``n``, not to be written to."""
    held = _powers.get(int(base), np.zeros(0, np.uint64))
    if len(held) <= n:
        held = np.full(n + 1, base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= POWERS:
            _powers[int(base)] = held
    return held[:n + 1]


def numbered(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of each value among the different ones, which are counted as they first appear, and how many there are."""
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy(), len(coded.dictionary)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of data[start:end] for every span, from one running sum."""
    up = powers(BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * up[:-1], out=total[1:])
    down = powers(BASE_INVERSE, len(data))
    return mixed((total[ends] - total[starts]) * down[starts])
