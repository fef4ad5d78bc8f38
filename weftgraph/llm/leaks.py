"""Benchmark decontamination by latent semantic retrieval.

Texts are read in passages of PASSAGE words. A passage is a TF-IDF vector; its coordinates are the words of the benchmark,
hashed to DIMS dimensions, and all other words count in its length only. The latent space is the range of a randomised
singular value decomposition of the passages of the corpus and of the benchmark, both with the same total energy: each task sums up
A'A W over its passages for one random matrix W, the sums are added by blocks of rows, and the driver orthonormalises
the DIMS x RANK result.

Then every passage, at steps of half a passage, is compared in that space with every piece of PIECE words of every item: by how much of
the piece it holds, the product of the two over the piece's own square. Neither what stands around a leak nor the length of the item lowers that.
The threshold is the item's own: the least part of its weight that a text can hold and pass the verification. A leak holds as large a part
of at least one of its pieces, and a piece that is there word by word lies whole in some passage. Candidates are verified in the words
around the passage: the longest common subsequence must hold most of the item, and, as an answer check, most of
the item's rarest words. Rewording inside an item lowers the share but does not hide it.

The benchmark is the query set; it is taken in blocks of PIECES pieces, fewer than the space has dimensions, so what is broadcast is
bounded by a block, or by its longest item. Nothing but sums
of counts is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import IS_SPACE, TO_LOWER, give_back, slices, span_hashes, text_bytes, words

PASSAGE = 32
PIECE = PASSAGE // 2
DIMS, RANK, PIECES = 2048, 768, 672
GROUP = 28  # pieces whose scores are bounded together
KEPT = 1e-3  # singular values below this part of the largest are dropped
SLACK = 0.8  # of the threshold: words put between, and what the space blurs
SHARE, ANSWER = 0.55, 0.5
SHORT = 8  # an item with fewer words must be there in full
PRODUCTS = 1 << 21  # that a task holds before it adds them up
ROWS = 64  # of the sketch, in one shuffled value
SLICE = 2 << 20
BREAKS = IS_SPACE.copy()
BREAKS[[c for c in range(128) if not chr(c).isalnum()]] = True


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text): lower case, without ASCII punctuation."""
    data, offsets = text_bytes(texts)
    data = TO_LOWER[data]
    starts, ends, firsts = words(data, offsets, BREAKS)
    return span_hashes(data, starts, ends), firsts


class Vocabulary:
    """The words of some items, and what a word weighs."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.dims = (self.hashes % np.uint64(DIMS)).astype(np.int64)
        self.weight = np.ones(len(self.hashes))
        self.outside = 1.0

    def plain(self) -> tuple:
        """What a broadcast carries: arrays, which need no import where they arrive."""
        return self.hashes, self.weight, self.outside

    @classmethod
    def of(cls, plain: tuple) -> Vocabulary:
        out = cls(plain[0])
        _, out.weight, out.outside = plain
        return out

    def weigh(self, counts: np.ndarray, passages: int) -> None:
        self.weight = np.log1p(max(passages, 1) / np.maximum(counts, 1))
        self.outside = float(np.log1p(max(passages, 1)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that are in the vocabulary, their numbers)."""
        at = np.flatnonzero(self.near[(hashes >> np.uint64(44)).astype(np.int64)])
        number = np.searchsorted(self.hashes, hashes[at])
        number[number == len(self.hashes)] = 0
        held = self.hashes[number] == hashes[at]
        return at[held], number[held]

    def norms(self, where: np.ndarray, number: np.ndarray, group: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Length of the vector of each group of words; ``group`` holds the group of the words found."""
        inside = np.bincount(group, self.weight[number] ** 2, len(sizes))
        return np.sqrt(inside + (sizes - np.bincount(group, minlength=len(sizes))) * self.outside**2)


def _passages(firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first passage of each text, passage of every word) for passages of ``size`` words that never cross texts."""
    counts = np.diff(firsts)
    begin = np.append(0, np.cumsum(-(-counts // size)))
    place = np.arange(firsts[-1]) - np.repeat(firsts[:-1], counts)
    return begin, np.repeat(begin[:-1], counts) + place // size


def _counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """How often the corpus has each word of the vocabulary, and its number of passages."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.plain())

    def counted(batches):
        known = Vocabulary.of(shared.value)
        total = np.zeros(len(known.hashes) + 1, np.int64)
        for batch in batches:
            for piece in slices(batch, most=SLICE):
                hashes, firsts = _words(piece.column(0))
                total[:-1] += np.bincount(known.find(hashes)[1], minlength=len(known.hashes))
                total[-1] += _passages(firsts, PASSAGE)[0][-1]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"word": used, "n": total[used]})

    # one row for each word of a block of items
    found = docs.select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(vocabulary.hashes) + 1, np.int64)
    total[found.column("word").to_numpy()] = found.column("n").to_numpy()
    return total[:-1], int(total[-1])


def _products(known: Vocabulary, hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of the products that A'A adds up, on and above the order of the words, for the normalised vectors A of the passages."""
    begin, passage = _passages(firsts, size)
    at, number = known.find(hashes)
    group = passage[at]
    norm = known.norms(at, number, group, np.bincount(passage, minlength=begin[-1]).astype(float))
    value = known.weight[number] / norm[group]
    dims = known.dims[number]
    codes, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    n = np.bincount(group, minlength=begin[-1])
    ahead = np.cumsum(n)[group] - np.arange(len(group)) - 1  # found words of the passage that follow
    step, live = 0, np.arange(len(group))
    while len(live):  # each word with the step-th after it
        values.append(value[live] * value[live + step] * (1.0 if step == 0 else 2.0))
        codes.append(dims[live] * DIMS + dims[live + step])
        step += 1
        live = live[ahead[live] >= step]
    return np.concatenate(codes), np.concatenate(values)


def _gram(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A'A from its products."""
    codes, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    out = np.bincount(codes, values, DIMS * DIMS).reshape(DIMS, DIMS)
    return ((out + out.T) / 2).astype(np.float32)


def _random(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((DIMS, RANK)).astype(np.float32)


def _sketch(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, float]:
    """(A'A W, energy of A) over all passages of the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.plain())

    def summed(batches):
        known, gram = Vocabulary.of(shared.value), np.zeros((DIMS, DIMS), np.float32)
        waiting, held = [], 0
        for batch in batches:
            for piece in slices(batch, most=SLICE):
                waiting.append(_products(known, *_words(piece.column(0)), PASSAGE))
                held += len(waiting[-1][0])
                if held >= PRODUCTS:
                    gram += _gram(waiting)
                    waiting, held = [], 0
        if waiting:
            gram += _gram(waiting)
        if gram.any():
            out = gram @ _random()
            blocks = [out[i:i + ROWS].tobytes() for i in range(0, DIMS, ROWS)]
            energy = [float(np.trace(gram))] + [0.0] * (len(blocks) - 1)
            yield pa.RecordBatch.from_pydict({"block": list(range(len(blocks))), "rows": pa.array(blocks, pa.binary()), "energy": energy})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, energy, block = np.zeros(ROWS * RANK), 0.0, 0
        for batch in batches:
            block = batch.column(0)[0].as_py()
            energy += sum(batch.column(2).to_pylist())
            for rows in batch.column(1):
                total += np.frombuffer(rows.as_buffer(), np.float32)
        yield pa.RecordBatch.from_pydict({"block": [block], "rows": pa.array([total.tobytes()], pa.binary()), "energy": [energy]})

    schema = "block long, rows binary, energy double"
    sums = docs.select("text").mapInArrow(summed, schema).groupBy("block").applyInArrow(added, schema).collect()  # DIMS x RANK numbers
    out = np.zeros((DIMS, RANK))
    for row in sums:
        out[row.block * ROWS:(row.block + 1) * ROWS] = np.frombuffer(bytes(row.rows)).reshape(ROWS, RANK)
    return out, sum(row.energy for row in sums)


class Item:
    """A benchmark item, its words by their numbers in the vocabulary."""

    def __init__(self, key, hashes: np.ndarray, vocabulary: Vocabulary):
        _, number = vocabulary.find(hashes)
        self.key, self.words = key, number.tolist()
        weight = vocabulary.weight[number]
        rare = np.sort(np.argsort(-weight, kind="stable")[: max(1, len(weight) // 3)])
        self.places, self.answer = self._masks(self.words), self._masks([self.words[i] for i in rare])
        self.rare = len(rare)

    @staticmethod
    def _masks(sequence: list[int]) -> dict[int, int]:
        masks: dict[int, int] = {}
        for i, word in enumerate(sequence):
            masks[word] = masks.get(word, 0) | 1 << i
        return masks

    @staticmethod
    def common(masks: dict[int, int], n: int, text: list[int]) -> int:
        """Length of the longest common subsequence, with a bit for each word of the item."""
        full = (1 << n) - 1
        row = full
        for word in text:
            hit = row & masks.get(word, 0)
            if hit:
                row = ((row + hit) | (row - hit)) & full
        return n - row.bit_count()

    def shares(self, text: list[int]) -> tuple[float, float]:
        """Parts of the item and of its rarest words found in order."""
        held = [w for w in text if w in self.places]
        return (self.common(self.places, len(self.words), held) / len(self.words),
                self.common(self.answer, self.rare, held) / self.rare)


def least_held(weight: np.ndarray) -> float:
    """The least part of an item's squared weight that words can hold which pass the verification."""
    n = len(weight)
    square = np.sort(weight**2)
    rare = max(1, n // 3)
    need = n if n < SHORT else int(np.ceil(SHARE * n - 1e-9))
    answer = int(np.ceil(ANSWER * rare - 1e-9))
    low, high = square[:n - rare], square[n - rare:]
    rest = np.sort(np.append(low, high[answer:]))[:max(0, need - answer)]
    return float((high[:answer].sum() + rest.sum()) / square.sum())


def _space(corpus: tuple[np.ndarray, float], own: tuple[np.ndarray, float]) -> np.ndarray:
    """The left singular vectors of the passages, from one product of their Gram matrix G with the random matrix W.

    G is close to GW (W'GW)^-1 (GW)', whose square root GW L'^-1 with LL' = W'GW has the singular vectors and values asked for.
    """
    total = sum(part.astype(np.float64) / energy for part, energy in (corpus, own) if energy > 0)
    core = _random().astype(np.float64).T @ total
    core = (core + core.T) / 2
    core += np.eye(len(core)) * 1e-7 * np.trace(core)
    root = np.linalg.solve(np.linalg.cholesky(core), total.T).T
    vectors, values, _ = np.linalg.svd(root, full_matrices=False)
    return vectors[:, values > KEPT * values[0]]


def _block(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashes, firsts = _words(pa.array([t for _, t in items], pa.string()))
    vocabulary = Vocabulary(hashes)
    vocabulary.weigh(*_counts(docs, vocabulary))
    own = _gram([_products(vocabulary, hashes, firsts, PIECE)])  # a piece is one passage
    space = _space(_sketch(docs, vocabulary), (own @ _random(), float(np.trace(own))))
    known = [(key, hashes[a:z]) for (key, _), a, z in zip(items, firsts[:-1], firsts[1:], strict=True)]
    begin, piece = _passages(firsts, PIECE)
    owner = np.repeat(np.arange(len(items)), np.diff(begin))
    vectors = np.zeros((int(begin[-1]), DIMS))
    at, number = vocabulary.find(hashes)
    np.add.at(vectors, (piece[at], vocabulary.dims[number]), vocabulary.weight[number])
    weight = vocabulary.weight[number]
    least = SLACK * np.array([least_held(weight[a:z]) for a, z in zip(firsts[:-1], firsts[1:], strict=True)])[owner]
    latent = vectors @ space
    # score of a word for each piece: the part of the piece that it holds, of what the space keeps of it, over the threshold
    square = np.maximum((latent**2).sum(axis=1), 1e-12)
    towards = (space @ (latent / (square * least)[:, None]).T)[vocabulary.dims] * vocabulary.weight[:, None]
    parts = [np.ascontiguousarray(towards[:, g:g + GROUP], np.float32) for g in range(0, towards.shape[1], GROUP)]
    tops = np.stack([np.maximum(part, 0).max(axis=1) for part in parts], axis=1)  # the most that a word adds to a piece of each group
    model = (vocabulary.plain(), parts, tops, known, owner, least * np.linalg.norm(vectors, axis=1))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del own, space, vectors, latent, towards, model
    give_back()

    def searched(batches):
        plain, parts, tops, known, owner, scale = shared.value
        words_of = Vocabulary.of(plain)
        found = [Item(key, held, words_of) for key, held in known]
        model = words_of, parts, tops, found, _often(found, len(words_of.hashes)), owner, scale
        for batch in batches:
            for piece in slices(batch, most=SLICE):
                yield _search(piece, model)

    return docs.select("doc_id", "text").mapInArrow(
        searched, f"doc_id {kind}, item_id long, cosine double, share double, answer double")


def _often(items: list[Item], n_words: int) -> np.ndarray:
    """How often each item has each word of the block."""
    return np.stack([np.bincount(item.words, minlength=n_words) for item in items]).astype(np.int32)


def _covered(often: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> np.ndarray:
    """How many words of each ``item`` are among the known words low to high, each counted as often as the item has it."""
    order = np.argsort(number, kind="stable")
    earlier = np.full(len(number), -1)  # place of the same word before
    same = np.flatnonzero(number[order[1:]] == number[order[:-1]])
    earlier[order[same + 1]] = order[same]
    out = np.zeros(len(item), np.int64)
    n = high - low
    ends = np.cumsum(n)
    begin = 0
    while begin < len(item):  # runs of candidates with a bounded number of words
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PRODUCTS, side="right")))
        m = n[begin:stop]
        of = np.repeat(np.arange(begin, stop), m)
        place = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m) + low[of]
        first = earlier[place] < low[of]
        of, place = of[first], place[first]
        out[begin:stop] = np.bincount(of - begin, often[item[of], number[place]], stop - begin)
        begin = stop
    return out


def _summed(values: np.ndarray, number: np.ndarray, group: np.ndarray, wanted: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the words' rows of ``values`` in the ``wanted`` segments, and where a segment's sum is; the last one is zero."""
    at = np.flatnonzero(wanted[group])
    of = group[at]  # ascending
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    found = of[starts]
    sums = np.zeros((len(found) + 1, values.shape[1]), values.dtype)
    counts = np.diff(np.append(starts, len(of)))
    order = np.argsort(-counts, kind="stable")
    starts, counts, rows = starts[order], counts[order], number[at]
    for step in range(counts[0] if len(counts) else 0):  # the step-th words of all segments that have so many
        n = np.searchsorted(-counts, -step)
        sums[:n] += values[rows[starts[:n] + step]]
    place = np.full(segments + 1, len(found))
    place[found[order]] = np.arange(len(found))
    return sums, place


def _hits(number, group, open_, follows, parts, tops) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, piece, score) of every score of 1 or more, by window. Pieces go in groups, and what a group can reach at most is summed first."""
    segments = len(follows)
    after = np.where(follows, np.arange(1, segments + 1), segments)

    def over(windows, values):
        wanted = np.zeros(segments + 1, bool)
        wanted[windows] = wanted[after[windows]] = True
        sums, place = _summed(values, number, group, wanted, segments)
        place[segments] = len(sums) - 1
        return sums[place[windows]] + sums[place[after[windows]]]

    reach = over(open_, tops) >= 1 - 1e-4
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for g, part in enumerate(parts):
        windows = open_[reach[:, g]]
        if len(windows):
            score = over(windows, part)
            w, piece = np.nonzero(score >= 1)
            out.append((windows[w], piece + g * GROUP, score[w, piece]))
    window, piece, score = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(window, kind="stable")
    return window[order], piece[order], score[order]


def _search(piece: pa.RecordBatch, model: tuple) -> pa.RecordBatch:
    vocabulary, parts, tops, items, often, owner, scale = model
    hashes, firsts = _words(piece.column(1))
    half = PASSAGE // 2
    begin, segment = _passages(firsts, half)
    segments = int(begin[-1])
    at, number = vocabulary.find(hashes)
    group = segment[at]
    sizes = np.bincount(segment, minlength=segments).astype(float)
    squares = vocabulary.norms(at, number, group, sizes) ** 2
    bound = np.bincount(group, tops.max(axis=1)[number], segments)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    follows = np.append(text[1:] == text[:-1], False)  # the next segment belongs to the same text
    after = lambda x: np.where(follows, np.append(x[1:], 0), 0)
    length = np.sqrt(np.maximum(squares + after(squares), 1e-12))
    open_ = np.flatnonzero(bound + after(bound) >= 1)
    before = np.searchsorted(at, np.arange(len(hashes) + 1))  # known words before each word
    best: dict = {}
    if len(open_):
        window, hit, score = _hits(number, group, open_, follows, parts, tops)
        # of a window's pieces of one item the nearest
        pair = window * len(items) + owner[hit]
        order = np.argsort(pair, kind="stable")
        pair, first = np.unique(pair[order], return_index=True)
        cosines = np.maximum.reduceat((score * scale[hit] / length[window])[order], first) if len(first) else np.zeros(0)
        window, item = pair // len(items), pair % len(items)
        doc, n = text[window], np.array([len(i.words) for i in items])[item]
        near = firsts[doc] + (window - begin[doc]) * half
        low = before[np.maximum(near - n, firsts[doc])]
        high = before[np.minimum(near + PASSAGE + n, firsts[doc + 1])]
        # most candidates have too few of the item's words in any order
        enough = np.flatnonzero(_covered(often, item, low, high, number) >= SHARE * n)
        doc, item, low, high, cosines = (x[enough] for x in (doc, item, low, high, cosines))
        numbers = number.tolist()
        for d, i, a, z, cosine in zip(doc.tolist(), item.tolist(), low.tolist(), high.tolist(), cosines.tolist(), strict=True):
            share, answer = items[i].shares(numbers[a:z])
            if share >= (SHARE if len(items[i].words) >= SHORT else 1.0) and answer >= ANSWER:
                best[d, i] = max(best.get((d, i), (0.0, 0.0, 0.0)), (share, answer, cosine))
    keys = piece.column(0)
    rows = sorted(best)
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array([d for d, _ in rows], pa.int64())), pa.array([items[i].key for _, i in rows], pa.int64()),
         *[pa.array([best[r][k] for r in rows], pa.float64()) for k in (2, 0, 1)]],
        names=["doc_id", "item_id", "cosine", "share", "answer"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, share, answer): the benchmark items that a document holds, reworded or not.

    ``share`` and ``answer`` are the parts of the item, and of its rarest words, found in order. Items without words, or null, are never
    found; null texts hold none. A repeated row is reported once, a repeated item under each of its ids. Other columns are ignored. An
    empty corpus or benchmark gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, cosine double, share double, answer double")
    block: list = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("bigint"), "text").toLocalIterator():
        pieces = -(-len(_words(pa.array([row.text]))[0]) // PIECE) if row.text else 0
        if block and held + pieces > PIECES:
            out, block, held = out.unionByName(_block(docs, block)), [], 0
        if pieces:
            block.append((row.item_id, row.text))
            held += pieces
    if block:
        out = out.unionByName(_block(docs, block))
    return out.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("share", "answer", "cosine")).alias("b")).select("doc_id", "item_id", "b.cosine", "b.share", "b.answer")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    key = F.xxhash64("doc_id", "text")
    held = leaks(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(held, key == F.col("_held"), "left_anti")
