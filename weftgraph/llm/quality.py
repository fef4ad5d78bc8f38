"""Quality rules with an n-gram model: perplexity bands for each language.

For each language a modified Kneser-Ney model of character n-grams is counted by Spark. Given labels, it learns from documents that pass
the base rule and that a first model, of half of the documents labelled good, does not find odd: a model that
has read the junk finds it likely. Lower orders use continuation counts and each order has three discounts from its counts of counts. Training
ends in one row per n-gram: its hash, its interpolated log probability, and as a context its back-off weight. Rows are broadcast as
sorted arrays, ``PART_ROWS`` at a time, so that the driver holds one such part only. When the model outgrows ``SLICE_ROWS`` it is cut
into slices by the hash of the two characters that every n-gram and context of a position share; the corpus is read once for each, and
what a slice says of a text is kept under the text's digest, so that no text is written. A document's log likelihood is the sum over slices.

A document is rejected if its perplexity leaves the band of its language: the median of the language's log perplexities, less
or plus a multiple of their median absolute deviation. Where labels are given, the multiples are moved so that the fewest labelled
documents are misjudged: all of them are put in order across partitions, and each batch of the order hands on the few places where a
best band can end.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import ODD, give_back, mixed, numbered, slices, span_hashes, text_bytes, words
from weftgraph.session import cut, cut_count

ORDER = 5
SLICE_ROWS = 12_000_000  # of 12 bytes, held by a worker in one reading of the corpus
PART_ROWS = 1_000_000  # in a broadcast
GRAMS = 500_000  # different n-grams that a task holds before it adds up their counts
LOWER, UPPER = 7.5, 4.5  # deviations of log perplexity
FLOOR = 0.01  # the least deviation taken, so that a uniform language does not reject on noise
UNSURE = 2.0  # deviations of few documents are widened by this over the root of their number
REPEAT = 8
MIN_WORDS = 20
LEAST = 8  # good documents, in either half of the labelled ones, without which a language counts as unlabelled
SLICE = 1 << 19
BITS = 1 << 26  # of the table that tells which documents a set may name
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
START = "\x02"


def rules(texts: pa.Array) -> dict[str, np.ndarray]:
    """Word and line counts of every text."""
    data, offsets = text_bytes(texts)
    starts, ends, firsts = words(data, offsets)
    n_words = np.diff(firsts)

    def summed(per_byte):
        total = np.append(0, np.cumsum(per_byte, dtype=np.int64))
        return total[offsets[1:]] - total[offsets[:-1]], total

    head = (data & 0xC0) != 0x80  # a byte that begins a code point
    total = np.append(0, np.cumsum(head, dtype=np.int64))
    in_words = np.append(0, np.cumsum(total[ends] - total[starts]))
    symbols, _ = summed(IS_SYMBOL[data])
    line_starts, line_ends = _lines(data, offsets, starts)
    hashes = span_hashes(data, np.append(starts, line_starts), np.append(ends, line_ends))
    return {
        "n_words": n_words, "word_chars": in_words[firsts[1:]] - in_words[firsts[:-1]], "n_symbols": symbols,
        "n_dup_lines": _repeated_lines(offsets, line_starts, hashes[len(starts):] + (line_ends - line_starts).astype(np.uint64)),
        "n_repeat_words": _repeated_words(hashes[:len(starts)], firsts),
    }


def _later(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places with an owner and a value: which have an equal earlier, and which an equal earlier or later."""
    code, n = numbered(mixed(mixed(owner.astype(np.uint64)) + value * ODD))
    # numbers are given in the order of first appearance
    earlier = code <= np.maximum.accumulate(np.append(-1, code[:-1])) if len(code) else np.zeros(0, bool)
    return earlier, np.bincount(code, minlength=n)[code] > 1


def _lines(data, offsets, word_starts):
    """Start and end of every line with a word."""
    breaks = np.flatnonzero(data == 10)
    # a line runs from its text's start or a break to the next break or the text's end
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    filled = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    return starts[filled], ends[filled]


def _repeated_lines(offsets, starts, hashes):
    owner = np.searchsorted(offsets, starts, side="right") - 1
    earlier, _ = _later(owner, hashes)
    return np.bincount(owner[earlier], minlength=len(offsets) - 1)


def _repeated_words(hashes, firsts):
    """Words that lie in a window of ``REPEAT`` words which the text holds twice."""
    n, size = len(hashes), len(firsts) - 1
    if n < REPEAT:
        return np.zeros(size, np.int64)
    rolled = np.zeros(n - REPEAT + 1, np.uint64)
    for k in range(REPEAT):
        rolled = mixed(rolled + hashes[k:n - REPEAT + 1 + k] * ODD)
    owner = np.repeat(np.arange(size), np.diff(firsts))
    whole = owner[: len(rolled)] == owner[REPEAT - 1:]
    at = np.flatnonzero(whole)
    _, twice = _later(owner[at], rolled[at])
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + REPEAT, -1)
    return np.bincount(owner[np.cumsum(covered)[:-1] > 0], minlength=size)


# --- the model ---------------------------------------------------------------

BASE = np.uint64(0x100000001B3)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 start marks, and where each text begins."""
    pad = START * (ORDER - 1)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    chars = np.frombuffer("".join(pad + s for s in strings).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return chars, np.append(0, np.cumsum(lengths + ORDER - 1))


def _places(begin: np.ndarray) -> np.ndarray:
    """Where the n-grams of all texts begin: none runs from one text into the start marks of the next."""
    inside = np.ones(max(0, int(begin[-1]) - ORDER + 1), bool)
    for k in range(1, ORDER):
        inside[begin[1:-1] - k] = False
    return np.flatnonzero(inside)


def _lang_code(lang: str | None) -> np.uint64:
    return np.frombuffer(hashlib.md5(repr(lang).encode()).digest(), "<u8", 1)[0]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often every n-gram of ``ORDER`` characters occurs in the texts of each language."""

    def summed(parts):
        """Hashes of the different n-grams, how often each occurs, and its characters."""
        hashes, n, chars = (np.concatenate(x) for x in zip(*parts, strict=True))
        code, size = numbered(hashes)
        first = np.zeros(size, np.int64)
        first[code] = np.arange(len(code))
        return hashes[first], np.bincount(code, n, size).astype(np.int64), chars[first]

    def rows(held):
        for lang, parts in held.items():
            _, n, chars = summed(parts)
            text = chars.tobytes().decode("utf-32-le").encode()
            sizes = 1 + (chars >= 0x80).astype(np.int32) + (chars >= 0x800) + (chars >= 0x10000)
            ends = np.append(0, np.cumsum(sizes.sum(axis=1))).astype(np.int32)
            grams = pa.StringArray.from_buffers(len(n), pa.py_buffer(ends), pa.py_buffer(text))
            for at in range(0, len(n), 1 << 16):
                some = grams[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some, pa.array(n[at:at + (1 << 16)])],
                                                 names=["lang", "gram", "n"])

    def counted(batches):
        held, waiting = {}, 0
        for batch in batches:
            for piece in slices(batch, most=SLICE):
                langs = piece.column(1).to_pylist()
                texts = piece.column(0).to_pylist()
                for lang in dict.fromkeys(langs):
                    chars, begin = _codes([t for t, x in zip(texts, langs, strict=True) if x == lang and t])
                    place = _places(begin)
                    if not len(place):
                        continue
                    code, size = numbered(_windows(chars, np.uint64(0))[place])
                    at = np.zeros(size, np.int64)
                    at[code] = place
                    window = [chars[at + k] for k in range(ORDER)]
                    held.setdefault(lang, []).append((
                        _of(window, np.uint64(0), size), np.bincount(code, minlength=size), np.stack(window, 1).astype("<u4")))
                    waiting += size
                if waiting > GRAMS:
                    held = {lang: [summed(parts)] for lang, parts in held.items()}
                    waiting = sum(len(parts[0][0]) for parts in held.values())
                    if 2 * waiting > GRAMS:
                        yield from rows(held)
                        held, waiting = {}, 0
        yield from rows(held)
        held.clear()
        give_back()

    return docs.select("text", "lang").mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


def train(docs: DataFrame) -> DataFrame:
    """(lang, gram, is_context, value): the modified Kneser-Ney model of each language.

    For a gram, ``value`` is the interpolated log probability of its last character after the others; the empty gram stands
    for a character never seen. For a context it is the log weight of what the next shorter context says.
    """
    levels = {ORDER: cut(count_grams(docs))}
    for k in range(ORDER - 1, 0, -1):  # how many different characters precede
        levels[k] = cut(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(
            F.count(F.lit(1)).alias("n")))
    even = levels[1].groupBy("lang").agg((1.0 / (F.count(F.lit(1)) + 1)).alias("p")).select("lang", F.lit("").alias("gram"), "p")
    rows, lower = [even], even
    for k in range(1, ORDER + 1):
        shares = _shares(levels[k], k)
        below = lower.select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), F.col("p").alias("_low"))
        joined = shares.join(below, F.col("lang").eqNullSafe(F.col("_lang")) & (F.substring("gram", 2, k - 1) == F.col("_gram")))
        lower = cut(joined.select("lang", "gram", (F.col("own") + F.col("rest") * F.col("_low")).alias("p")))
        rows += [lower, shares.groupBy("lang", "context").agg(F.first("rest").alias("p"), F.lit(True).alias("is_context"))
                 .withColumnRenamed("context", "gram")]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows).select(
        "lang", "gram", F.coalesce("is_context", F.lit(False)).alias("is_context"), F.log("p").alias("value"))


def _shares(level: DataFrame, k: int) -> DataFrame:
    """(lang, gram, context, own, rest): the discounted share of each gram, and what its context leaves to lower orders."""
    times = level.groupBy("lang").agg(*[F.sum((F.col("n") == i).cast("double")).alias(f"t{i}") for i in (1, 2, 3, 4)])
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))

    def discount(i):  # outside (0, i) the counts of counts are too few to say
        d = i - (i + 1) * y * F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}"))
        return F.when((d > 0) & (d < i), d).otherwise(F.lit(0.5)).alias(f"d{i}")

    discounts = times.select(F.col("lang").alias("_lang"), *[discount(i) for i in (1, 2, 3)])
    whole = Window.partitionBy("lang", "context")
    cut_by = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return (
        level.join(discounts, F.col("lang").eqNullSafe(F.col("_lang")))
        .select("lang", "gram", "n", cut_by.alias("d"), F.substring("gram", 1, k - 1).alias("context"))
        .withColumns({"total": F.sum("n").over(whole), "freed": F.sum("d").over(whole)})
        .select("lang", "gram", "context", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"),
                (F.col("freed") / F.col("total")).alias("rest"))
    )


def _hashed(model: DataFrame) -> DataFrame:
    """(is_context, hash, value) of the rows of the model; the hashes are made where the rows are."""

    def rows(batches):
        for batch in batches:
            langs, grams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            code = {lang: _lang_code(lang) for lang in set(langs)}
            lang = np.array([code[x] for x in langs], np.uint64)
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            hashes = np.zeros(len(grams), np.uint64)
            for k in range(ORDER + 1):
                at = np.flatnonzero(sizes == k)
                text = "".join(grams[i] for i in at).encode("utf-32-le")
                chars = np.frombuffer(text, np.uint32).astype(np.uint64).reshape(len(at), k)
                hashes[at] = _of(list(chars.T), lang[at], len(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(hashes.view(np.int64)), batch.column(3).cast(pa.float32())], names=["is_context", "hash", "value"])

    return model.select("lang", "gram", "is_context", "value").mapInArrow(rows, "is_context boolean, hash long, value float")


def _arrays(rows: pa.Table) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((hashes in order, log probabilities), (hashes in order, back-off weights)) of hashed rows of the model."""
    context = rows.column("is_context").to_numpy()
    hashes, values = rows.column("hash").to_numpy().view(np.uint64), rows.column("value").to_numpy()
    out = []
    for mine in (~context, context):
        order = np.argsort(hashes[mine])
        out.append((hashes[mine][order], values[mine][order]))
    return tuple(out)


def _of(window: list[np.ndarray], lang, n: int) -> np.ndarray:
    """Hash of the characters that stand in the columns of ``window``, for a language."""
    h = np.zeros(n, np.uint64)
    for chars in window:
        h *= BASE
        h += chars
        h += np.uint64(1)
    h ^= np.atleast_1d(lang + np.uint64(len(window))) * ODD
    return mixed(h)


def _windows(chars: np.ndarray, lang) -> np.ndarray:
    """``_of`` the ``ORDER`` characters from every place on."""
    size = len(chars) - ORDER + 1
    return _of([chars[k:size + k] for k in range(ORDER)], lang, size)


def _range(hashes: np.ndarray, n: int) -> np.ndarray:
    """The part that holds each hash, of ``n`` parts."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _find(tables: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, found) for each hash; there is a table for each range of hashes."""
    value, found = np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    part = _range(wanted, len(tables))
    for i, (hashes, values) in enumerate(tables):
        mine = np.flatnonzero(part == i)
        if len(hashes) and len(mine):
            at = np.minimum(np.searchsorted(hashes, wanted[mine]), len(hashes) - 1)
            value[mine] = values[at]
            found[mine] = hashes[at] == wanted[mine]
    return value, found


def _slice_of(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    pair = first << np.uint64(32) | second
    code, size = numbered(pair)
    different = np.zeros(size, np.uint64)
    different[code] = pair
    names = (chr(p >> 32) + chr(p & 0xFFFFFFFF) for p in different.tolist())
    return np.fromiter((zlib.crc32(x.encode("utf-8", "surrogatepass")) % n for x in names), np.int64, size)[code]


def likelihoods(strings: list[str], lang: np.uint64, tables, share: tuple[int, int] = (0, 1)) -> np.ndarray:
    """For each text the log likelihood of its characters, or of those that fall to slice share[0] of share[1]."""
    probabilities, weights = zip(*tables, strict=True)
    chars, begin = _codes(strings)
    at = _places(begin)
    if not len(at):
        return np.zeros(len(strings))
    owner = np.repeat(np.arange(len(strings)), np.diff(begin))[at]
    hashes = _windows(chars, lang)[at]
    if share[1] > 1:
        mine = _slice_of(chars[at + ORDER - 3], chars[at + ORDER - 2], share[1]) == share[0]
        at, owner, hashes = at[mine], owner[mine], hashes[mine]
    # each different gram is looked up once, in the order of its hash
    code, size = numbered(hashes)
    first = np.zeros(size, np.int64)
    first[code] = np.arange(len(code))
    full = hashes[first]
    order = np.argsort(full)
    place = np.zeros(size, np.int64)
    place[order] = np.arange(size)
    full, first = full[order], at[first[order]]
    window = [chars[first + k] for k in range(ORDER)]
    value, todo = np.zeros(size), np.arange(size)
    for n in range(ORDER, -1, -1):
        found, hit = _find(probabilities, full if n == ORDER else _of(window[ORDER - n:], lang, len(todo)))
        value[todo[hit]] += found[hit]
        todo, window = todo[~hit], [w[~hit] for w in window]
        if not n or not len(todo):
            break
        weight, hit = _find(weights, _of(window[ORDER - n:ORDER - 1], lang, len(todo)))
        value[todo[hit]] += weight[hit]
    return np.bincount(owner, value[place][code], len(strings))


def _all_likelihoods(texts: list[str], langs: list, shared: list, share: tuple[int, int] = (0, 1)) -> np.ndarray:
    """``likelihoods`` of texts of several languages."""
    tables, found = [part.value for part in shared], np.zeros(len(texts))
    for lang in dict.fromkeys(langs):
        mine = [k for k, x in enumerate(langs) if x == lang]
        found[mine] = likelihoods([texts[k] for k in mine], _lang_code(lang), tables, share)
    return found


def _shared(hashed: DataFrame) -> list:
    """Broadcasts of hashed rows of the model, one for each range of hashes; the driver holds one at a time."""
    rows, n = cut_count(hashed)
    parts = max(1, -(-n // PART_ROWS))
    part = F.shiftright(F.shiftrightunsigned("hash", 32) * parts, 32)
    out = []
    for i in range(parts):
        out.append(rows.sparkSession.sparkContext.broadcast(_arrays(rows.where(part == i).toArrow())))
        give_back()
    return out


def _mark(text: str, lang: str | None) -> bytes:
    return hashlib.blake2b(f"{lang!r} {text}".encode(), digest_size=16).digest()


def scored(docs: DataFrame, model: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, the word and line counts of ``rules``, n_points and log_perplexity.

    ``n_points`` counts the code points; without any, log_perplexity is null.
    """
    slices_ = max(1, -(-model.count() // SLICE_ROWS))
    kept = [c for c in keep if c not in FRESH]
    counts = [c for c in FRESH if c != "log_perplexity"]
    whole = docs.select(F.col("text").alias("_text"), F.col("lang").alias("_lang"), *kept)
    fields = [*whole.schema.fields[2:], *[T.StructField(c, T.LongType()) for c in counts]]

    def read(batches):  # of each piece: its texts, their languages, the columns kept and the counts
        for batch in batches:
            for piece in slices(batch, "_text", SLICE):
                strings = [t or "" for t in piece.column(0).to_pylist()]
                lengths = np.fromiter(map(len, strings), np.int64, len(strings))
                numbers = [*rules(piece.column(0)).values(), lengths]
                yield strings, piece.column(1).to_pylist(), [*piece.columns[2:], *[pa.array(v, pa.int64()) for v in numbers]], lengths

    if slices_ == 1:
        shared = _shared(_hashed(model))
        schema = T.StructType([*fields, T.StructField("log_perplexity", T.DoubleType())])

        def measured(batches):
            for strings, langs, columns, lengths in read(batches):
                found = -_all_likelihoods(strings, langs, shared) / np.maximum(lengths, 1)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64(), mask=lengths == 0)], names=schema.names)

        return whole.mapInArrow(measured, schema)

    def marked(batches):
        for strings, langs, columns, _ in read(batches):
            marks = [_mark(t, x) for t, x in zip(strings, langs, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(marks, pa.binary())], names=[f.name for f in fields] + ["_mark"])

    parts = _sliced(docs, model, slices_)
    sums = reduce(lambda x, y: x.unionByName(y), [part.withColumn("_slice", F.lit(i)) for i, part in enumerate(parts)]).groupBy("_key").agg(
        *[F.max(F.when(F.col("_slice") == i, F.col("_found"))).alias(f"_found{i}") for i in range(slices_)])
    found = reduce(lambda x, y: x + y, [F.col(f"_found{i}") for i in range(slices_)])
    out = whole.mapInArrow(marked, T.StructType([*fields, T.StructField("_mark", T.BinaryType())]))
    return out.join(sums.select("_key", found.alias("_found")), F.col("_mark") == F.col("_key")).select(
        *[f"`{f.name}`" for f in fields], F.when(F.col("n_points") > 0, -F.col("_found") / F.col("n_points")).alias("log_perplexity"))


def _sliced(docs: DataFrame, model: DataFrame, n: int) -> list[DataFrame]:
    """For each of ``n`` slices of the model (_key, _found): its share of the log likelihood of every different text and language."""
    pair = F.when(F.col("is_context"), F.substring("gram", -2, 2)).otherwise(
        F.expr("substring(gram, length(gram) - 2, 2)"))
    low = F.length("gram") < F.when(F.col("is_context"), 2).otherwise(3)
    out = []
    for i in range(n):
        shared = _shared(_hashed(model.where(low | (F.crc32(pair) % n == i))))

        def measured(batches, shared=shared, share=(i, n)):
            for batch in batches:
                for piece in slices(batch, most=SLICE):
                    strings, langs = [t or "" for t in piece.column(0).to_pylist()], piece.column(1).to_pylist()
                    marks = [_mark(t, x) for t, x in zip(strings, langs, strict=True)]
                    found = _all_likelihoods(strings, langs, shared, share)
                    yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(found)], names=["_key", "_found"])

        out.append(cut(docs.select("text", "lang").mapInArrow(measured, "_key binary, _found double").dropDuplicates(["_key"])))
        for part in shared:
            part.unpersist()
    return out


FRESH = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_points", "log_perplexity"]


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_id, good, held) of all labelled documents: in the order of a hash, every second one of a language is held back.

    ``held`` ones set the first bands, the others the first model. The order is counted in 256 ranges of the hash.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") > 0).alias("good"))
    ids = docs.select(F.col("doc_id").alias("_id"), "lang").dropDuplicates(["_id"])
    drawn = cut(known.join(ids, "_id").withColumn("_h", F.xxhash64("_id")).withColumn("_range", F.shiftright("_h", 56)))
    before = Window.partitionBy("lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = drawn.groupBy("lang", "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("lang").alias("_of"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    turn = F.col("_start") + F.row_number().over(Window.partitionBy("lang", "_range").orderBy("_h", "_id"))
    return cut(drawn.join(starts, _same() & (F.col("_range") == F.col("_at"))).select("_id", "good", (turn % 2 == 0).alias("held")))


def _maybe(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """All documents that ``chosen`` names, and few others, so that few texts are shuffled: by a table of bits of a fixed size."""
    if docs.schema["doc_id"].dataType != chosen.schema["_id"].dataType:
        return docs
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(BITS - 1))
    found = chosen.select(place("_id").alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(place & 63)))").alias("bits")).toArrow()  # BITS / 64 rows at most
    table = np.zeros(BITS >> 6, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def named(places: pa.Array) -> pa.Array:
        at = places.to_numpy()
        return pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return docs.where(named(place("doc_id")))


def _among(docs: DataFrame, chosen: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the documents that ``chosen`` names, one row for each id."""
    return docs.join(chosen, F.col("doc_id") == F.col("_id")).dropDuplicates(["doc_id"]).select(*columns)


def _centred(measured: DataFrame) -> DataFrame:
    """(_of, _middle, _length, _spread): median and deviation of the log perplexities of each language."""
    half = lambda c: F.percentile_approx(c, 0.5, 10_000)
    middle = measured.groupBy(F.col("lang").alias("_of")).agg(
        half("log_perplexity").alias("_middle"), half("n_points").alias("_length"))
    return cut(measured.select("lang", "log_perplexity", "n_points").join(middle, _same()).groupBy("_of", "_middle", "_length").agg(
        (F.greatest(half(F.abs(_off())), F.lit(FLOOR)) * (1 + UNSURE / F.sqrt(F.count(F.lit(1))))).alias("_spread")))


def _same():
    return F.col("lang").eqNullSafe(F.col("_of"))


def _off():
    """Distance from the language's median, less for short texts."""
    widened = F.greatest(F.lit(1.0), F.sqrt(F.col("_length") / F.greatest("n_points", F.lit(1))))
    return (F.col("log_perplexity") - F.col("_middle")) / widened


def _failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _best(gain: np.ndarray) -> tuple[int, int]:
    """(start, stop) of the run with the greatest sum."""
    total = np.append(0, np.cumsum(gain))
    least = np.minimum.accumulate(total)
    stop = int(np.argmax(total[1:] - least[:-1])) + 1
    return int(np.argmin(total[:stop])), stop


def _ends(first: np.ndarray, last: np.ndarray, gain: np.ndarray, lower: float, upper: float) -> tuple[float, float]:
    """``edges`` of runs of documents in order: their first and last deviation, and the good ones less the junk."""
    start, stop = _best(gain)
    below = (last[start - 1] + first[start]) / 2 if start else -np.inf
    above = (last[stop - 1] + first[stop]) / 2 if stop < len(first) else np.inf
    return float(min(first[start], max(-lower, below))), float(max(last[stop - 1], min(upper, above)))


def edges(off: np.ndarray, good: np.ndarray, lower: float = LOWER, upper: float = UPPER) -> tuple[float, float]:
    """The ends of the band, in deviations, that misjudge the fewest labelled documents.

    Between the outermost good document inside and the nearest junk outside, an end stays as near to its default as it can.
    """
    order = np.argsort(off, kind="stable")
    return _ends(off[order], off[order], np.where(good[order], 1, -1), lower, upper)


def _runs(batches):
    """Of rows in order, the runs between the places where a best band can begin or end: at most five a batch and language."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        off, gain, good = (batch.column(i).to_numpy() for i in (1, 2, 3))
        turns = [0, *[i for i in range(1, len(langs)) if langs[i] != langs[i - 1]], len(langs)]
        for a, b in zip(turns[:-1], turns[1:], strict=True):
            total = np.append(0, np.cumsum(gain[a:b]))
            # a band begins or ends inside, or comes from a row before, or goes on to a row after
            places = {0, b - a, int(np.argmin(total[:-1])), int(np.argmax(total[1:])) + 1, *_best(gain[a:b])}
            at = a + np.array(sorted(places))
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[a]] * (len(at) - 1), pa.string()), pa.array(off[at[:-1]]), pa.array(off[at[1:] - 1]),
                 pa.array(np.diff(total[at - a])), pa.array(np.diff(np.append(0, np.cumsum(good[a:b]))[at - a]))],
                names=["lang", "first", "last", "gain", "good"])


def _labelled_bands(labelled: DataFrame, middles: DataFrame, lower: float, upper: float) -> DataFrame:
    """(_in, _low, _high) of each language with at least ``LEAST`` good documents in ``labelled``, scored.

    Documents of one deviation stay together, so that no end falls between them.
    """

    def fitted(table: pa.Table) -> pa.Table:  # a few runs for each batch of labelled documents
        order = np.argsort(table.column("first").to_numpy(), kind="stable")
        first, last, gain, good = (table.column(c).to_numpy()[order] for c in ("first", "last", "gain", "good"))
        low, high = _ends(first, last, gain, lower, upper) if good.sum() >= LEAST else (None, None)
        return pa.table({"_in": table.column("lang").slice(0, 1), "_low": pa.array([low], pa.float64()), "_high": pa.array([high], pa.float64())})

    placed = labelled.where(~_failed() & F.col("log_perplexity").isNotNull()).join(middles, _same()).select(
        "lang", "good", (_off() / F.col("_spread")).alias("off"))
    ordered = cut(placed.groupBy("lang", "off").agg(
        F.sum(F.when(F.col("good"), 1).otherwise(-1)).alias("gain"), F.count_if("good").alias("good")))
    return ordered.repartitionByRange("lang", "off").sortWithinPartitions("lang", "off").mapInArrow(
        _runs, "lang string, first double, last double, gain long, good long").groupBy("lang").applyInArrow(
        fitted, "_in string, _low double, _high double").where("_low is not null")


def _judged(measured: DataFrame, middles: DataFrame, bands: DataFrame | None, lower: float, upper: float) -> DataFrame:
    """``measured`` with _inside: whether the log perplexity is in the band of the language."""
    out = measured.join(middles, _same(), "left")
    low, high = F.lit(-lower), F.lit(upper)
    if bands is not None:
        out = out.join(bands, F.col("lang").eqNullSafe(F.col("_in")), "left")
        low, high = F.coalesce("_low", low), F.coalesce("_high", high)
    return out.withColumn("_inside", F.coalesce((_off() / F.col("_spread")).between(low, high), F.lit(False)))


def _learned(docs: DataFrame, labelled: DataFrame | None, lower: float, upper: float) -> DataFrame:
    """(text, lang) of the documents that the model learns from."""
    texts = docs.select("text", "lang")
    if labelled is None:  # nothing tells good from odd
        return texts
    used = labelled.where(F.col("good") | F.col("held"))
    known = cut(_among(_maybe(docs, used), used, "text", "lang", "good", "held"))
    first = cut(train(known.where(F.col("good") & ~F.col("held")).select("text", "lang")))
    held = cut(scored(known.where("held"), first, ["lang", "good"]))
    middles = _centred(held.where("good"))
    bands = cut(_labelled_bands(held, middles, lower, upper))
    # a language without enough labels goes by the base rule alone
    judged = _judged(scored(texts, first, ["text", "lang"]), middles, bands, lower, upper)
    return judged.where(~_failed() & (F.col("_inside") | F.col("_low").isNull())).select("text", "lang")


def verdicts(docs: DataFrame, keep: list[str] | None = None, lower: float = LOWER, upper: float = UPPER,
             labels: DataFrame | None = None) -> DataFrame:
    """The columns ``keep`` (default all) with the counts of ``rules``, log_perplexity, base_failed and kept.

    Base rule: fewer than MIN_WORDS words, or more than 30 % of the words in repeated windows. A null or empty text fails it.
    The mean over a short text scatters more, so a band widens with the root of the median length over a text's length.
    ``labels`` (doc_id, quality) sets what the model learns from, and the bands; a language without enough labels learns from what
    passes the base rule and takes ``lower`` and ``upper`` deviations. Without ``labels`` the model learns from all documents.
    Documents without a language have a model and a band of their own. Input columns with the new names are replaced; repeated rows are
    judged each. An empty table gives an empty one.
    """
    keep = [c for c in keep or docs.columns if c not in ("base_failed", "kept", *FRESH)]
    labelled = _labelled(docs, labels) if labels is not None else None
    model = cut(train(_learned(docs, labelled, lower, upper)))
    measured = cut(scored(docs, model, list(dict.fromkeys([*keep, "lang", *(["doc_id"] if labels is not None else [])]))))
    middles = _centred(measured)
    bands = None
    if labelled is not None:
        points = _among(measured, labelled, "lang", "good", "n_words", "n_repeat_words", "n_points", "log_perplexity")
        bands = cut(_labelled_bands(points, middles, lower, upper))
    return _judged(measured, middles, bands, lower, upper).select(
        *keep, *FRESH, _failed().alias("base_failed"), (~_failed() & F.col("_inside")).alias("kept"))
