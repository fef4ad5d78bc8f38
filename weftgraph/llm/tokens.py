"""Token-id files: texts are tokenised, written in document order as Simple-8b files, and read back.

Documents are range-partitioned by id and sorted. Each task tokenises its texts and writes a row for every
``FILE_IDS`` ids or so: a file image (see ``simple8b``) and where it begins within the task's part. The rows are a
Parquet dataset, so any store that Spark writes will do. Adding the parts' totals in order gives the place of every
document in the whole stream; the table of parts has one row per task and is left to adaptive execution.

A text is tokenised as pieces that start at single spaces between two characters which are not white space. The
tokenizer's pattern always ends a match there, so pieces can be encoded alone, each different one once
per slice, and put together by gathering. Pieces go through the tokenizer's own steps: its pattern cuts them into
words, all those of a slice at once, and its model encodes each different word once per cache. The tokenizer's added tokens are matched before its pattern and may take white
space with them, so a text that holds one is encoded whole by the library.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm import simple8b
from weftgraph.llm.common import give_back, slices
from weftgraph.session import scratch_path

END_ID = 0
FILE_IDS = 1 << 20
SLICE = 2 << 20
WORD_CACHE, CACHE = 600_000, 200_000  # different words, and pieces of unusual characters, remembered by a worker; past it the memory starts anew
FILE_SCHEMA = "part int, file int, first long, n_docs long, n_ids long, image binary"
PIECES = re.compile(r"(?<=\S) (?=\S)")
SOLID = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"  # not white space by any definition in use
SPACE = "\u0120"  # how the vocabulary writes a space
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# the tokenizer's pattern for texts of these characters; others go through the library's own splitter
COMMON = re.compile(rf"[\t\n\x20-\x7e{LETTERS}]*")
CLOSE = "\0"  # stands behind each piece where many are cut into words at once
WORDS = re.compile(rf"{CLOSE}|'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}{CLOSE}]+|\s+(?![^\s{CLOSE}])|\s+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet of the vocabulary, for the characters of ``COMMON``: printable bytes stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x100)}


class Pool(dict):
    """Numbers of strings, given as they are first asked for, and the ids that each stands for, one after the other."""

    def __init__(self):
        self.fresh: list[str] = []  # numbered, but without ids yet
        self.held = 0
        self.ids, self.start, self.length = np.zeros(1 << 16, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, string: str) -> int:
        self.fresh.append(string)
        self[string] = n = len(self)
        return n

    def numbers(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, strings), np.int64, len(strings))

    def add(self, coded: list[list[int]]) -> None:
        """The ids of ``fresh``."""
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.uint32, int(length.sum()))
        while self.held + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.held:self.held + len(ids)] = ids
        self.start = np.append(self.start, self.held + np.cumsum(length) - length)
        self.length = np.append(self.length, length)
        self.held += len(ids)
        self.fresh = []

    def at(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all numbers in a row, number of ids of each)."""
        return _gathered(self.ids, self.start, self.length, numbers)


def _gathered(ids: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs ``which`` of ids in a row, their lengths)."""
    start, length = start[which], length[which]
    total = np.append(0, np.cumsum(length))
    return ids[np.repeat(start - total[:-1], length) + np.arange(total[-1])], length


class Pieces:
    """Ids of the pieces seen so far, and of the words in them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.whole, self.model, self.splitter, self.letters = tokenizer, tokenizer.model, tokenizer.pre_tokenizer, _byte_letters()
        # what may be an added token; the library decides
        contents = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = "(?i)" + "|".join(contents) if contents else None
        self.words, self.others = self._words(), Pool()

    @staticmethod
    def _words() -> Pool:
        """No word yet, and no ids for what closes a piece."""
        out = Pool()
        out.numbers([CLOSE])
        out.add([[]])
        return out

    def _common(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``coded`` for pieces of the characters in ``COMMON``: all are cut into words at once, and each different word is encoded once."""
        if len(self.words) > WORD_CACHE:
            self.words = self._words()
        words = self.words
        numbers = words.numbers(WORDS.findall(CLOSE.join([*pieces, ""])))
        if words.fresh:
            mapped = CLOSE.join(words.fresh).translate(self.letters).split(self.letters[ord(CLOSE)])
            words.add([[t.id for t in tokens] for tokens in map(self.model.tokenize, mapped)])
        ids, length = words.at(numbers)
        ends = np.flatnonzero(numbers == words[CLOSE])
        return ids, np.diff(np.append(0, np.cumsum(length)[ends]))

    def _other(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``coded`` for other pieces: the library's splitter cuts each different one."""
        if len(self.others) > CACHE:
            self.others = Pool()
        others = self.others
        numbers = others.numbers(pieces)
        if others.fresh:
            others.add([[t.id for mapped, _ in self.splitter.pre_tokenize_str(p) for t in self.model.tokenize(mapped)] for p in others.fresh])
        return others.at(numbers)

    def coded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each)."""
        if COMMON.fullmatch("".join(pieces)):
            return self._common(pieces)
        common = np.array([COMMON.fullmatch(p) is not None for p in pieces])
        (ids, length), (more, longer) = (
            how([pieces[i] for i in np.flatnonzero(mine)]) for how, mine in ((self._common, common), (self._other, ~common)))
        length, ids = np.append(length, longer), np.append(ids, more)
        place = np.where(common, np.cumsum(common) - 1, common.sum() + np.cumsum(~common) - 1)
        return _gathered(ids, np.cumsum(length) - length, length, place)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.added is None or not (held := pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)).any():
            return self._plain(texts)
        ids, counts = self._plain(pc.if_else(pa.array(held), pa.scalar("", pa.large_string()), texts))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(held):
            parts[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts without an added token; no text is null."""
        split = pc.split_pattern(texts, " ")
        counts = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        every = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        strings = pc.binary_join(every, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        code = coded.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(code), bool)
        begin = np.append(0, np.cumsum(counts))[:-1]
        first[begin] = True
        # a split holds only between two characters that are not white space
        head, tail = (pc.match_substring_regex(coded.dictionary, side).to_numpy(zero_copy_only=False)
                      for side in (rf"^{SOLID}", rf"{SOLID}\z"))
        wrong = ~first & ~(head[code] & np.append(False, tail[code[:-1]]))
        owner = np.repeat(np.arange(len(counts)), counts)
        odd = np.zeros(len(counts), bool)
        odd[owner[wrong]] = True
        plain = ~odd[owner]
        where, wanted = np.zeros((2, len(strings)), np.int64), []
        for spaced in (0, 1):
            used = np.zeros(len(strings), bool)
            used[code[plain & (first == (not spaced))]] = True
            at = np.flatnonzero(used)
            where[spaced, at] = np.arange(len(wanted), len(wanted) + len(at))
            wanted += [" " + strings[i] if spaced else strings[i] for i in at]
        place = where[(~first).astype(np.int64), code]
        if odd.any():  # their splits are found again, with a look at both sides
            again = dict(zip(wanted, range(len(wanted)), strict=True))
            parts = [place[begin[i]:begin[i] + counts[i]] if not odd[i] else np.array(
                [again.setdefault(p, len(again)) for p in _cut(texts[i].as_py())]) for i in range(len(counts))]
            counts = np.array([len(p) for p in parts])
            place = np.concatenate(parts)
            wanted = list(again)
        ids, length = self.coded(wanted)
        ids, length = _gathered(ids, np.cumsum(length) - length, length, place)
        total = np.append(0, np.cumsum(length))
        return ids, np.diff(total[np.append(0, np.cumsum(counts))])


def _cut(text: str) -> list[str]:
    return [p if k == 0 else " " + p for k, p in enumerate(PIECES.split(text))]


@lru_cache(1)
def _pieces(path: str) -> Pieces:
    """The tokenizer of a worker, which knows the words of the tasks before."""
    return Pieces(path)


def _with_ends(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(counts + 1) - 1
    out = np.full(len(ids) + len(counts), END_ID, np.uint32)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = ids
    return out, counts + 1


def write_files(docs: DataFrame, tokenizer: str, path: str, file_ids: int = FILE_IDS) -> None:
    """Token files of (doc_id, text) below ``path``, in ascending doc_id order.

    A null text is empty and gives the end id alone; null ids come first; repeated ids are documents of their own, in the order of
    their texts. Other columns are ignored. An empty table writes an empty dataset.
    """

    def coded(batches):
        give_back()
        pieces = _pieces(tokenizer)
        part, file, first = TaskContext.get().partitionId(), 0, 0
        held: list = []

        def image():
            ids, lengths, keys, nulls = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "file": pa.array([file], pa.int32()), "first": [first],
                "n_docs": [len(lengths)], "n_ids": [len(ids)],
                "image": pa.array([simple8b.to_file(ids, keys, nulls, lengths)], pa.binary()),
            })

        for batch in batches:
            for piece in slices(batch, most=SLICE):
                keys = piece.column(0)
                ids, counts = pieces.encode(piece.column(1))
                held.append((*_with_ends(ids, counts), pc.fill_null(keys, 0).to_numpy(),
                             pc.is_null(keys).to_numpy(zero_copy_only=False)))
                if sum(len(h[0]) for h in held) >= file_ids:
                    yield image()
                    file, first, held = file + 1, first + sum(len(h[0]) for h in held), []
                    give_back()
        if held:
            yield image()
        give_back()

    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(coded, FILE_SCHEMA).write.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def decoded(batches):
        for batch in batches:
            for base, first, image in zip(*(batch.column(c) for c in ("base", "first", "image")), strict=True):
                ids, keys, nulls, lengths = simple8b.from_file(image.as_py())
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                start = ends - lengths
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(keys, pa.int64(), mask=nulls),
                    "start": start + base.as_py() + first.as_py(),
                    "n_tokens": lengths,
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(start, ends, strict=True)], pa.int64()),
                })

    # one row for each task that wrote: the number of partitions bounds it
    return files.select("part", "first", "image").join(F.broadcast(bases), "part").mapInArrow(
        decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files to the shared folder and return what they hold, one row per document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_files(docs, tokenizer, path)
    return read_files(spark, path)
