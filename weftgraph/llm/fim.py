"""Fill-in-the-middle transformation on a piece table.

A document is a sequence of descriptors (buffer, start, end) over two buffers that never change: the UTF-8 text, and the sentinels.
Cutting splits the descriptor that covers a place, an arrangement permutes the three parts and puts a sentinel's descriptor before each,
and the inverse permutation puts them back. Texts are copied once, where a transformed text is written; digests are
streamed from descriptor to descriptor. Units and code points are counted for a whole slice of a batch at once. Every
document is transformed on its own, so there is no shuffle and no state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weftgraph.llm.common import slices, text_bytes, words

PREFIX, MIDDLE, SUFFIX = range(3)  # in the order of the text
MARKS = (b"<P>", b"<M>", b"<S>")
SENTINELS = b"".join(MARKS)
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLAIN = "plain"
TEXT, SENTINEL = 0, 1
SEED, PLAIN_PERCENT, SPM_PERCENT = 42, 50, 80

Piece = tuple[int, int, int]


def cut(table: list[Piece], places: list[int]) -> list[list[Piece]]:
    """The parts of ``table`` between ascending ``places``, which are bytes from its start; a place may be either end."""
    parts: list[list[Piece]] = [[]]
    places, at = list(places), 0
    for buffer, start, end in table:
        while places and places[0] < at + end - start:
            here = start + places.pop(0) - at
            if here > start:
                parts[-1].append((buffer, start, here))
            at, start = at + here - start, here
            parts.append([])
        if end > start:
            parts[-1].append((buffer, start, end))
        at += end - start
    return parts + [[] for _ in places]


def arranged(parts: list[list[Piece]], form: str) -> list[Piece]:
    """The parts in the order of ``form``, each behind its sentinel."""
    return [piece for part in FORMS[form] for piece in ((SENTINEL, 3 * part, 3 * part + 3), *parts[part])]


def inverse(order: tuple[int, ...]) -> list[int]:
    return [order.index(part) for part in range(len(order))]


def parted(output: bytes, form: str) -> list[Piece]:
    """The pieces of an output of ``form`` over its own bytes, in the order of the text it was made from.

    A text that holds a sentinel is always plain, so the first of each sentinel in an output is the one put in.
    """
    if form == PLAIN:
        return [(TEXT, 0, len(output))]
    order = FORMS[form]
    places = [output.index(MARKS[part]) for part in order]
    parts = [(TEXT, start + 3, end) for start, end in zip(places, [*places[1:], len(output)], strict=True)]
    return [parts[i] for i in inverse(order)]


def streamed(table: list[Piece], text: memoryview) -> Iterator[memoryview]:
    buffers = text, memoryview(SENTINELS)
    for buffer, start, end in table:
        yield buffers[buffer][start:end]


def digest(table: list[Piece], text: memoryview) -> str:
    out = hashlib.sha256()
    for view in streamed(table, text):
        out.update(view)
    return out.hexdigest()


def draws(key, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    out = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(out[i:i + 4], "big") for i in range(0, 16, 4))


def _whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, memoryview]:
    data, offsets = text_bytes(texts)
    return data, offsets, memoryview(data.tobytes())


def transform(docs: DataFrame, key: str = "doc_id", seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output, output_sha256): every text, transformed or left plain.

    A unit is a word with the white space before it, or the white space at the end of a text; n counts them. A null or empty text has no
    unit and is plain, with an empty output, as is a text that holds a sentinel; the two lengths of a plain text are
    null. A text of one unit can still be cut, at either of its ends. A null key draws as an empty one, and rows with equal keys draw alike, so repeated
    rows give repeated results. Long texts are whole. Other columns are ignored. An empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()

    def transformed(batches):
        for batch in batches:
            for piece in slices(batch):
                data, offsets, view = _whole(piece.column(1))
                _, ends, firsts = words(data, offsets)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                texts = pc.fill_null(piece.column(1), "")
                held = np.zeros(len(texts), bool)
                for mark in MARKS:
                    held |= pc.match_substring(texts, mark.decode()).to_numpy(zero_copy_only=False)
                rows = []
                for i, name in enumerate(piece.column(0).to_pylist()):
                    begin, end = int(offsets[i]), int(offsets[i + 1])
                    stops = [begin, *ends[firsts[i]:firsts[i + 1]].tolist()]
                    if stops[-1] < end:
                        stops.append(end)
                    n = len(stops) - 1
                    first, second, plain, order = draws(name, seed)
                    table = [(TEXT, begin, end)] if end > begin else []
                    if not n or held[i] or plain % 100 >= plain_percent:
                        form, lengths = PLAIN, (None, None)
                    else:
                        form = "spm" if order % 100 < spm_percent else "psm"
                        a, b = (stops[x] for x in sorted((first % (n + 1), second % (n + 1))))
                        table = arranged(cut(table, [a - begin, b - begin]), form)
                        lengths = int(points[a] - points[begin]), int(points[b] - points[a])
                    rows.append((n, form, *lengths, b"".join(streamed(table, view)), digest(table, view)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *[pa.array(c, t) for c, t in zip(columns, FIELDS, strict=True)]],
                    names=[key, "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])

    FIELDS = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
    return docs.select(key, "text").mapInArrow(
        transformed, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")


def restore(outputs: DataFrame, with_text: bool = True) -> DataFrame:
    """``outputs`` with ``restored`` and ``restored_sha256``: the text that each ``output`` was made from, found from it and its ``form`` alone.

    ``with_text`` false leaves out the text and streams its digest only. A null output or form is an empty, plain one. Columns named as the new
    ones are replaced. An empty table gives an empty one.
    """
    fresh = ["restored", "restored_sha256"] if with_text else ["restored_sha256"]
    carried = outputs.drop("restored", "restored_sha256")

    def restored(batches):
        for batch in batches:
            for piece in slices(batch, "output"):
                of = piece.schema.get_field_index
                rows = []
                for output, form in zip(piece.column(of("output")).cast(pa.binary()).to_pylist(), piece.column(of("form")).to_pylist(), strict=True):
                    output = output or b""
                    table, view = parted(output, form or PLAIN), memoryview(output)
                    rows.append((b"".join(streamed(table, view)) if with_text else None, digest(table, view)))
                new = [pa.array([r[0] for r in rows], pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays([*piece.columns, *new, pa.array([r[1] for r in rows], pa.string())], names=[*piece.schema.names, *fresh])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema] + [f"{c} string" for c in fresh])
    return carried.mapInArrow(restored, schema)
