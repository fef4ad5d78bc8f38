"""Removing long repeats: bytes covered by a string of ``LEAST`` bytes that also starts anywhere else.

Windows of LEAST bytes are dealt out by their minimizer, the least hash among the ``GRAM``-byte strings in them: equal windows have
equal minimizers, and neighbouring windows mostly share theirs, so a text falls into segments (a run of windows with one
minimizer) and everything that could repeat meets under one key.

1. Keys that occur once in the corpus are done; that is most of the text.
2. Under the others, equal segments are one entry with a count. A segment that occurs twice is a repeat as a whole. Where a key
   holds different segments, the windows that they share are found from a Burrows-Wheeler transform of the segments (``bwt``), many
   keys to a transform.
3. A key with more than ``MOST`` different segments, as the edge of a passage quoted everywhere has, would be an unbounded transform. Its windows
   are counted by hash instead, combined before the shuffle: exact, and nothing is gathered.

Equal texts are one entry too; if they are long enough all their bytes go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import bwt
from weftgraph.llm.common import BASE, BASE_INVERSE, BYTE_HASH, mixed, powers, slices, text_bytes
from weftgraph.session import cut

LEAST = 400
GRAM = 160
MOST = 4096
TRANSFORM_BYTES = 1 << 20


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * powers(BASE, len(data))[:-1], out=total[1:])
    return mixed((total[size:] - total[:-size]) * powers(BASE_INVERSE, len(data))[:len(data) - size + 1])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours: running minima forwards and backwards within blocks of the width."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1:n])


def segments(data: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, last window, again) of the runs of windows with one minimizer, in order.

    ``again`` says that the minimizer occurs more than once in the run, without which the run cannot repeat within itself.
    """
    if len(data) < least:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    hashes, width = _gram_hashes(data, gram), least - gram + 1
    keys = _sliding_least(hashes, width)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    last = np.append(first[1:], len(keys)) - 1
    known, code = np.unique(keys[first], return_inverse=True)
    near = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hits = np.flatnonzero(known[near] == hashes)
    placed = np.sort(near[hits] * np.int64(len(data)) + hits)
    found = np.searchsorted(placed, code * np.int64(len(data)) + last + width - 1, side="right") - np.searchsorted(
        placed, code * np.int64(len(data)) + first)
    return keys[first], first, last, found > 1


def _each(texts: pa.Array):
    data, offsets = text_bytes(texts)
    return (data[a:z] for a, z in zip(offsets[:-1], offsets[1:], strict=True))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _scanned(docs: DataFrame, kind: str, least: int, gram: int) -> DataFrame:
    """(doc_id, n_bytes, sha, mark, keys) of every document; the keys are those of its segments, the mark is short for the sha."""

    def scan(batches):
        for batch in batches:
            for piece in slices(batch):
                sizes, shas, marks, keys = [], [], [], []
                for data in _each(piece.column(1)):
                    sizes.append(len(data))
                    sha = hashlib.sha256(data)
                    shas.append(sha.hexdigest())
                    marks.append(_short(sha.digest()))
                    found, _, _, again = segments(data, least, gram)
                    keys.append(_signed(np.append(found, found[again])))  # twice if the run may repeat itself
                offsets = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(marks, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))],
                    names=["doc_id", "n_bytes", "sha", "mark", "keys"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_bytes long, sha string, mark long, keys array<long>")


def _texts_of(docs: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """(sha, keys, packed): the compressed text of every wanted (doc_id, sha, keys)."""

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_short(hashlib.sha256(t.as_buffer()).digest()) for t in texts], pa.int64()),
                 pa.array([squeeze.compress(t.as_buffer()) for t in texts], pa.binary())], names=["doc_id", "mark", "packed"])

    texts = docs.select("doc_id", "text").mapInArrow(pack, f"doc_id {kind}, mark long, packed binary")
    asked = wanted.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "sha", "keys")
    # the text's own mark tells it from others under a repeated id
    found = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")))
    return found.select("sha", "mark", "keys", "packed")


def _unpacked(column: pa.Array):
    loosen = zstandard.ZstdDecompressor()
    for t in column:
        yield np.frombuffer(loosen.decompress(t.as_buffer()), np.uint8)


def _occurrences(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """(key, seg, mark, start, size, again) of every segment under a wanted key; ``seg`` names its content."""

    def scan(batches):
        for batch in batches:
            rows = []
            for mark, wanted, data in zip(batch.column(1).to_pylist(), batch.column(2), _unpacked(batch.column(3)), strict=True):
                keys, first, last, again = segments(data, least, gram)
                held = np.isin(_signed(keys), wanted.values.to_numpy())
                for key, a, z, more in zip(_signed(keys[held]), first[held], last[held] + least, again[held], strict=True):
                    rows.append((int(key), _short(hashlib.blake2b(data[a:z], digest_size=8).digest()), mark, int(a), int(z - a), int(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["key", "seg", "mark", "start", "size", "again"])

    return texts.select("sha", "mark", "keys", "packed").mapInArrow(
        scan, "key long, seg long, mark long, start long, size long, again long")


def _content(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, seg, content) of the asked (key, seg, mark, start, size)."""
    lists = asked.groupBy("mark").agg(F.collect_list(F.struct("key", "seg", "start", "size")).alias("asked"))

    def read(batches):
        for batch in batches:
            keys, segs, contents = [], [], []
            for wanted, data in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1)), strict=True):
                for w in wanted:
                    keys.append(w["key"])
                    segs.append(w["seg"])
                    contents.append(data[w["start"]:w["start"] + w["size"]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(segs, pa.int64()), pa.array(contents, pa.binary())], names=["key", "seg", "content"])

    return texts.join(lists, "mark").select("asked", "packed").mapInArrow(read, "key long, seg long, content binary")


def _ranges(starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs covered by windows at ascending ``starts``; runs that touch are one."""
    if not len(starts):
        return []
    apart = np.flatnonzero(starts[1:] - starts[:-1] > least)
    return list(zip(starts[np.append(0, apart + 1)].tolist(), (starts[np.append(apart, len(starts) - 1)] + least).tolist(), strict=True))


def _by_transform(contents: DataFrame, least: int) -> DataFrame:
    """(key, seg, low, high): the ranges of each segment that repeat in another place under its key or in itself."""

    def transformed(batches):
        held: list = []
        size = 0

        def out():
            found = bwt.repeated_starts([c for _, _, c in held], least)
            rows = [(key, seg, a, z) for (key, seg, _), starts in zip(held, found, strict=True) for a, z in _ranges(starts, least)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "seg", "low", "high"])

        for batch in batches:
            for key, seg, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if size > TRANSFORM_BYTES and key != held[-1][0]:
                    yield out()
                    held, size = [], 0
                held.append((key, seg, content))
                size += len(content)
        if held:
            yield out()

    # the rows of a key come one after the other, whole
    ordered = contents.repartition("key").sortWithinPartitions("key", "seg")
    return ordered.mapInArrow(transformed, "key long, seg long, low long, high long")


def _by_hash(contents: DataFrame, least: int) -> DataFrame:
    """The same as ``_by_transform``, from counts of window hashes."""

    def windows(batches):
        for batch in batches:
            for key, seg, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hashes = _signed(_gram_hashes(np.frombuffer(content, np.uint8), least))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hashes), key)), pa.array(np.full(len(hashes), seg)), pa.array(np.arange(len(hashes))),
                     pa.array(hashes)], names=["key", "seg", "at", "window"])

    rows = contents.mapInArrow(windows, "key long, seg long, at long, window long")
    often = rows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    return rows.join(often, "window", "left_semi").select("key", "seg", F.col("at").alias("low"), (F.col("at") + least).alias("high"))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def repeats(docs: DataFrame, least: int = LEAST, gram: int | None = None, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document.

    ``n_spans`` counts the maximal removed runs, ``kept`` is what is left as bytes where something is removed, else null. A null
    text is empty; repeated rows repeat each other's text. Null and repeated ids are documents of their own. Other columns are ignored. An
    empty table gives an empty one.
    """
    gram = gram or max(1, least * GRAM // LEAST)
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = cut(_scanned(docs, kind, least, gram))
    texts = cut(base.where(F.col("n_bytes") >= least).groupBy("sha").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.first("keys").alias("keys")))
    posted = texts.select("mark", F.explode("keys").alias("key"))
    often = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    asked = posted.join(often, "key", "left_semi").groupBy("mark").agg(F.collect_set("key").alias("keys"))
    held = cut(_texts_of(docs, texts.select("doc_id", "sha", "mark").join(asked, "mark"), kind).dropDuplicates(["mark"]))
    found = cut(_occurrences(held, least, gram))

    entries = found.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("mark", "start", "size", "again")).alias("at"))
    entries = cut(entries.select("key", "seg", "n", "at.*"))
    kinds = entries.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("again").alias("again"))
    mixed_up = kinds.where("kinds > 1 OR again > 0")
    contents = cut(_content(held, entries.join(mixed_up.select("key"), "key", "left_semi")).join(
        kinds.select("key", "kinds"), "key"))
    shared = _by_transform(contents.where(F.col("kinds") <= most).drop("kinds"), least).unionByName(
        _by_hash(contents.where(F.col("kinds") > most).drop("kinds"), least))
    whole = entries.where("n > 1").select("key", "seg", F.lit(0).cast("bigint").alias("low"), F.col("size").alias("high"))
    ranges = found.join(shared.unionByName(whole), ["key", "seg"]).select(
        "mark", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    removed = ranges.groupBy("mark").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    def rest(batches):
        for batch in batches:
            rows = []
            for mark, ranges, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unpacked(batch.column(2)), strict=True):
                runs = _merged([(r["low"], r["high"]) for r in ranges])
                bounds = [0, *(x for run in runs for x in run), len(data)]
                kept = b"".join(data[a:z].tobytes() for a, z in zip(bounds[0::2], bounds[1::2], strict=True))
                rows.append((mark, len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=["mark", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = held.join(removed, "mark").select("mark", "ranges", "packed").mapInArrow(
        rest, "mark long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    several = F.col("copies") > 1
    nothing = hashlib.sha256(b"").hexdigest()
    by_text = texts.select("sha", "mark", "copies").join(done, "mark", "left").select(
        "sha", several.alias("gone"), "n_removed", "n_spans", "kept_sha256", "kept").where("gone OR n_removed IS NOT NULL")
    gone = F.coalesce("gone", F.lit(False))
    return base.select("doc_id", "n_bytes", "sha").join(by_text, "sha", "left").select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
