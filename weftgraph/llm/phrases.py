"""Phrase collocation mining: frequent n-grams by mergeable Misra-Gries summaries, then exact counts.

A candidate and all its parts are n-grams with at least ``least`` occurrences in their language, so those are all that has to be found.
Each round reads the texts twice.

1. Survivors. A task counts the n-grams of about a million occurrences and deals them to hash partitions by the first bits of their
   hash. A partition's summary takes such counts one after the other; whenever it holds more counters than its capacity, the next
   largest count is taken off all of them. The capacity is the partition's mass, which is known before its first count, divided by
   ``least``, plus one, so what is taken off in all stays below ``least`` and every frequent n-gram survives. A task of the
   merge streams over its partitions, so it holds one summary at a time, of a size that does not depend on how often a hot n-gram occurs.
2. Counts. The survivors are marked in a bit table of fixed size, where a partition owns a range of bits. The second reading counts
   the n-grams that the table lets through, by their text; what got through by chance stays below ``least`` and is dropped.

There are three rounds: words, pairs of frequent words, and longer n-grams whose pairs are all frequent, as others cannot be. If the
survivors outgrow the table it lets more through, which costs shuffle and never a result. What follows the counts are joins and sums
keyed by language and phrase. The highest scores of a language are taken within salts first.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import IS_SPACE, ODD, TO_LOWER, mixed, slices, span_hashes, text_bytes, words
from weftgraph.session import cut

LEAST, LONGEST, TOP = 100, 5, 2000
FACTOR = 1000
UNKNOWN = "und"
TABLE_BITS = 26  # 8 MB
HELD = 1 << 21  # occurrences that a task gathers before it writes them as counts
KNOWN = 1 << 17  # different phrases that a task of the second reading holds
PART_MASS = 1 << 26  # occurrences of a hash partition aimed at
MOST_PARTS = 16  # bits
KEY_BYTES = 6  # of a hash, beside the bits that its partition says; those that agree in all of them survive together
SALTS = 256

IS_BREAK = np.zeros(256, bool)
IS_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
BETWEEN = IS_SPACE | IS_BREAK


class Summary:
    """Misra-Gries counters. ``taken`` is by how much a count may be too low; it stays below mass / capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Counts of different keys; those of another summary of the same capacity are merged the same way."""
        self._waiting.append((keys, counts))
        self._n += len(keys)
        if self._n > max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self._waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self._waiting]])
        self.keys, self.counts = _summed(keys, counts)
        self._waiting, self._n = [], 0
        over = len(self.keys) - self.capacity
        if over > 0:
            next_largest = np.partition(self.counts, over - 1)[over - 1]
            self.taken += int(next_largest)
            self.counts -= next_largest
            stays = self.counts > 0
            self.keys, self.counts = self.keys[stays], self.counts[stays]

    def survivors(self, least: int) -> np.ndarray:
        """Keys that may have ``least`` occurrences, ascending; all that have them are among these."""
        if self._waiting:
            self.merge()
        return self.keys[self.counts + self.taken >= least]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _marked(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    at = keys >> np.uint64(64 - bits)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Grams:
    """The words of a slice of texts and the hashes of their n-grams, each of one piece and one language.

    ``common`` holds the tables of frequent n-grams of 1, 2, ... words; an n-gram is left out if one of its parts is not in its table.
    """

    def __init__(self, texts: pa.Array, langs: pa.Array, common: list[np.ndarray], bits: int):
        data, offsets = text_bytes(texts)
        self.data, self.common, self.bits = TO_LOWER[data], common, bits
        self.starts, self.ends, firsts = words(self.data, offsets, BETWEEN)
        coded = langs.fill_null(UNKNOWN).dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        self.code = np.repeat(coded.indices.to_numpy(), np.diff(firsts))
        salt = np.array([hash_of(n) for n in self.names], np.uint64)
        self.word = span_hashes(self.data, self.starts, self.ends)
        self.first = mixed(self.word + salt[self.code] * ODD)
        n = len(self.starts)
        breaks = np.concatenate([[0], np.cumsum(IS_BREAK[self.data])])
        self.linked = np.zeros(n, bool)  # with the next word
        if n:
            self.linked[:-1] = breaks[self.starts[1:]] == breaks[self.ends[:-1]]
            last = firsts[1:] - 1
            self.linked[last[last >= 0]] = False

    def of(self, longest: int):
        """(number of words, first word of every n-gram, its hash) for each length up to ``longest``."""
        at, h = np.arange(len(self.starts)), self.first
        yield 1, at, h
        for size in range(2, longest + 1):
            if size - 2 < len(self.common):
                on = _marked(self.common[size - 2], h, self.bits)
                at, h = at[on], h[on]
            here = np.zeros(len(self.starts) + 1, bool)
            here[at] = True
            on = here[at + 1] & self.linked[at]
            at, h = at[on], h[on]
            h = mixed(h * ODD + self.word[at + size - 1])
            yield size, at, h

    def text(self, at: int, size: int) -> str:
        return b" ".join(self.data[self.starts[i]:self.ends[i]].tobytes() for i in range(at, at + size)).decode()


def hash_of(name: str) -> int:
    data = np.frombuffer(name.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def _packed(keys: np.ndarray, part_bits: int) -> bytes:
    low = (keys << np.uint64(part_bits)) >> np.uint64(64 - 8 * KEY_BYTES)
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpacked(packed: bytes, part: int, part_bits: int) -> np.ndarray:
    wide = np.zeros((len(packed) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, KEY_BYTES)
    low = wide.reshape(-1).view("<u8").astype(np.uint64) << np.uint64(64 - 8 * KEY_BYTES)
    return low >> np.uint64(part_bits) | np.uint64(part << (64 - part_bits))


def _counted(batches, sizes, common, bits, part_bits):
    """First reading: (part, mass) rows, and (part, keys, counts) rows of what a task has gathered."""
    held, n, masses = [], 0, np.zeros(1 << part_bits, np.int64)

    def written():
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(keys >> np.uint64(64 - part_bits), np.arange((1 << part_bits) + 1, dtype=np.uint64))
        sums = np.concatenate([[0], np.cumsum(counts)])
        masses[:] += sums[edges[1:]] - sums[edges[:-1]]
        used = np.flatnonzero(np.diff(edges))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.nulls(len(used), pa.int64()),
             pa.array([_packed(keys[edges[p]:edges[p + 1]], part_bits) for p in used], pa.binary()),
             pa.array([counts[edges[p]:edges[p + 1]].astype(np.uint32).tobytes() for p in used], pa.binary())],
            names=["part", "mass", "keys", "counts"])

    for batch in batches:
        for piece in slices(batch):
            grams = Grams(piece.column(0), piece.column(1), common, bits)
            for size, _, h in grams.of(max(sizes)):
                if size in sizes and len(h):
                    held.append(h)
                    n += len(h)
            if n >= HELD:
                yield from written()
                held, n = [], 0
    if held:
        yield from written()
    used = np.flatnonzero(masses)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int64()), pa.array(masses[used], pa.int64()), pa.nulls(len(used), pa.binary()), pa.nulls(len(used), pa.binary())],
        names=["part", "mass", "keys", "counts"])


def _merged(batches, least, bits, part_bits):
    """Rows by (part, masses first): the marked range of the bit table of each partition, packed."""
    part, mass, summary = None, 0, None

    def written():
        marks = np.zeros(1 << (bits - part_bits), bool)
        base = part << (bits - part_bits)
        marks[(summary.survivors(least) >> np.uint64(64 - bits)).astype(np.int64) - base] = True
        return pa.RecordBatch.from_arrays(
            [pa.array([base >> 3], pa.int64()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], names=["at", "marks"])

    for batch in batches:
        for p, m, keys, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if p != part:
                if summary is not None:
                    yield written()
                part, mass, summary = p, 0, None
            if m is not None:
                mass += m
                continue
            summary = summary or Summary(mass // least + 1)
            summary.add(_unpacked(keys, part, part_bits), np.frombuffer(counts, np.uint32).astype(np.int64))
    if summary is not None:
        yield written()


def _part_bits(texts: DataFrame, mass: int, bits: int) -> int:
    reducers = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(reducers - 1, mass // PART_MASS, 1).bit_length(), MOST_PARTS, bits - 3)


def survivors(texts: DataFrame, sizes: tuple[int, ...], least: int, mass: int, common=(), bits: int = TABLE_BITS) -> np.ndarray:
    """The bit table of every n-gram of ``sizes`` that may occur ``least`` times in its language; ``mass`` is at least the number of occurrences.

    ``common`` has broadcasts of the tables of shorter n-grams. The driver receives the table, whose size is fixed.
    """
    part_bits = _part_bits(texts, mass, bits)

    def counted(batches):
        return _counted(batches, sizes, [t.value for t in common], bits, part_bits)

    counts = texts.mapInArrow(counted, "part long, mass long, keys binary, counts binary")
    dealt = counts.repartition("part").sortWithinPartitions("part", F.col("mass").isNull())
    marked = dealt.mapInArrow(partial(_merged, least=least, bits=bits, part_bits=part_bits), "at long, marks binary")
    table = np.zeros(1 << (bits - 3), np.uint8)
    for row in marked.collect():  # as many bytes as the table has, one row for each partition
        mark = np.frombuffer(row.marks, np.uint8)
        table[row.at:row.at + len(mark)] |= mark
    return table


_PACKED = "part long, langs array<string>, sizes array<int>, phrases array<string>, n array<long>"


def _tallied(batches, sizes, table, common, bits, part_bits):
    """Second reading: for each hash partition the phrases that the table lets through, counted by a task, and words by language as size 0."""
    known, held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.zeros(0, np.int64)  # of each known key in ``what``
    what: list[tuple[str, int, str]] = []
    totals: dict[str, int] = {}

    def written(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)],
            names=["part", "langs", "sizes", "phrases", "n"])

    def parts():
        edges = np.searchsorted(known >> np.uint64(64 - part_bits), np.arange((1 << part_bits) + 1, dtype=np.uint64))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            mine = range(edges[p], edges[p + 1])
            langs, lengths, texts = zip(*[what[place[i]] for i in mine], strict=True)
            yield p, langs, lengths, texts, held[edges[p]:edges[p + 1]].tolist()

    for batch in batches:
        for piece in slices(batch):
            grams = Grams(piece.column(0), piece.column(1), common, bits)
            if 1 in sizes:
                for name, n in zip(grams.names, np.bincount(grams.code, minlength=len(grams.names)).tolist(), strict=True):
                    totals[name] = totals.get(name, 0) + n
            for size, at, h in grams.of(max(sizes)):
                if size not in sizes:
                    continue
                on = _marked(table, h, bits)
                h, first, n = np.unique(h[on], return_index=True, return_counts=True)
                at = at[on][first]
                spot = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                old = known[spot] == h if len(known) else np.zeros(len(h), bool)
                held[spot[old]] += n[old]
                fresh = ~old
                if fresh.any():
                    place = np.concatenate([place, np.arange(len(what), len(what) + int(fresh.sum()))])
                    what += [(grams.names[grams.code[i]], size, grams.text(i, size)) for i in at[fresh].tolist()]
                    known, held = np.concatenate([known, h[fresh]]), np.concatenate([held, n[fresh]])
                    order = np.argsort(known, kind="stable")
                    known, held, place = known[order], held[order], place[order]
            if len(known) > KNOWN:
                yield written(parts())
                known, held, place, what = known[:0], held[:0], place[:0], []
    yield written(parts())
    if totals:
        yield written([(0, list(totals), [0] * len(totals), [""] * len(totals), list(totals.values()))])


def _added_up(batches, least):
    """Rows by part: the phrases of one partition at a time, those with ``least`` occurrences and the totals."""
    part, held = None, {}

    def written():
        rows = [(*k, n) for k, n in held.items() if n >= least or not k[1]]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "size", "phrase", "f"])

    for batch in batches:
        for i in range(batch.num_rows):
            p, *lists = (c[i].as_py() for c in batch.columns)
            if p != part:
                if held:
                    yield written()
                part, held = p, {}
            for lang, size, phrase, n in zip(*lists, strict=True):
                held[lang, size, phrase] = held.get((lang, size, phrase), 0) + n
    if held:
        yield written()


def counts(texts: DataFrame, sizes: tuple[int, ...], least: int, mass: int, table, common=(), bits: int = TABLE_BITS) -> DataFrame:
    """(lang, size, phrase, f): exact counts of the n-grams of ``sizes`` with at least ``least`` occurrences.

    With size 1 among them, a row of size 0 holds a language's number of words. Phrases in one task are told apart by 64
    bits of their hash, between tasks by their text.
    """
    part_bits = _part_bits(texts, mass, bits)

    def tallied(batches):
        return _tallied(batches, sizes, table.value, [t.value for t in common], bits, part_bits)

    dealt = texts.mapInArrow(tallied, _PACKED).repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(partial(_added_up, least=least), "lang string, size int, phrase string, f long")


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = TABLE_BITS) -> DataFrame:
    """(lang, size, phrase, f) of every n-gram of up to ``longest`` words with ``least`` occurrences, and the totals as size 0."""
    texts = docs.select("text", F.col("lang").cast("string").alias("lang"))
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    mass = int(texts.agg(F.sum((length + 1) / 2)).first()[0] or 0)
    found, tables = None, []
    for sizes in ((1,), (2,), tuple(range(3, longest + 1))):
        if not sizes or sizes[0] > longest:
            continue
        table = docs.sparkSession.sparkContext.broadcast(survivors(texts, sizes, least, mass * len(sizes), tables, bits))
        more = cut(counts(texts, sizes, least, mass * len(sizes), table, tables, bits))
        found = more if found is None else found.unionByName(more)
        tables.append(table)
        mass = more.where("size > 0").agg(F.sum("f")).first()[0] or 0  # no more longer ones than these
    return found


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of each language by score.

    The score of a cut into l and r occurrences is floor(1000 a n / (l r)); the lowest counts, the earliest cut of equal ones. A phrase goes
    if a longer one that holds it occurs as often. Order: score, then a, descending, then the phrase by its bytes. A null
    text is empty, a null language is ``und`` together with that name; repeated rows count each; long texts are read whole; other columns
    are ignored. An empty table gives an empty one.
    """
    grams = frequent(docs, least, longest)
    f = grams.where("size > 0").select("lang", "phrase", "f")
    totals = grams.where("size = 0").select("lang", F.col("f").alias("n"))
    named = grams.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # phrases inside a longer one that occurs as often
    begin, length = F.col("s.begin"), F.col("s.length")
    inner = named.where("size > 2").select("lang", "a", "w", F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> struct(i AS begin, k AS length))))")).alias("s"))
    held = inner.select("lang", F.array_join(F.slice("w", begin, length), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    whole = named.join(held, ["lang", "phrase"], "left").where("inside IS NULL OR inside < a").drop("inside")

    k = F.col("k")
    cuts = whole.select("lang", "size", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "w").select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), k), " ").alias("first"),
        F.array_join(F.slice("w", k + 1, F.col("size")), " ").alias("rest"))
    scored = (
        cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        .join(totals, "lang")
        .select("lang", "phrase", "a", "k", "l", "r", "n",
                F.expr(f"({FACTOR} * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))").alias("score"))
    )
    least_cut = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    order = F.desc("score"), F.desc("a"), "phrase"
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    salted = least_cut.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    return ranked(ranked(salted, "lang", "salt").drop("rank"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
