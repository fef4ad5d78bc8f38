"""Chat formatting checked by a grammar round trip.

    conversation := turn*            turn := open text close
    system:    <<SYS>> ... <</SYS>>        user:  [INST] ... [/INST]
    assistant: <s> ... </s>                other: [ROLE] role [TEXT] ... [/ROLE]

Inside a text, a control string is escaped by a backslash after its first character (``</s>`` becomes
``<\\/s>``), and one that already carries backslashes there gets one more, which can be undone without looking at anything
else. Most texts hold no control string and are rendered as they are. Every turn is rendered, read back by the parser and
compared with its source; a text that does not come back is escaped and tried again. A turn that reads
back alone also reads back inside its conversation, because the parser never looks past a close mark, so turns are rendered
row by row and only then put together. A conversation is written as blocks of whole turns and read back block by block: its turns are sorted
into one task, which spills, and streamed through it, so no task holds more than a block and a batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER, MIDDLE, OTHER_END = "[ROLE]", "[TEXT]", "[/ROLE]"
CONTROLS = [m for pair in MARKS.values() for m in pair] + [OTHER, MIDDLE, OTHER_END]
_TAILS = "|".join(re.escape(m[1:]) for m in CONTROLS)
_PLAIN = re.compile(rf"([<\[])(?=\\*(?:{_TAILS}))")
_ESCAPED = re.compile(rf"([<\[])\\(?=\\*(?:{_TAILS}))")
_OPEN = re.compile("|".join(re.escape(m) for m in [*(p[0] for p in MARKS.values()), OTHER]))
_BY_OPEN = {p[0]: (role, p[1]) for role, p in MARKS.items()}
LEARNED = "assistant"
BLOCK = 1 << 14  # characters in one row of output, unless a turn holds more; a batch holds 10,000 rows


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Malformed(ValueError):
    pass


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; the span is the escaped text's."""
    at = 0
    while at < len(rendered):
        head = _OPEN.match(rendered, at)
        if head is None:
            raise Malformed(f"no turn begins at {at}")
        start = head.end()
        if head.group() == OTHER:
            middle = rendered.find(MIDDLE, start)
            if middle < 0:
                raise Malformed(f"no role ends after {at}")
            role, close, start = unescape(rendered[start:middle]), OTHER_END, middle + len(MIDDLE)
        else:
            role, close = _BY_OPEN[head.group()]
        end = rendered.find(close, start)
        if end < 0:
            raise Malformed(f"the turn at {at} does not end")
        yield role, unescape(rendered[start:end]), start, end
        at = end + len(close)


def _reads_back(rendered: str, role: str, text: str) -> bool:
    try:
        return [turn[:2] for turn in parse(rendered)] == [(role, text)]
    except Malformed:
        return False


def render(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, start, end of its text); the first of the plain and the escaped form that reads back."""
    for change in (str, escape):
        body, name = change(text), change(role)
        opened, closed = MARKS.get(role, (f"{OTHER}{name}{MIDDLE}", OTHER_END))
        rendered = opened + body + closed
        if _reads_back(rendered, role, text):
            return rendered, len(opened), len(opened) + len(body)
    raise Malformed(f"a turn of role {role!r} cannot be written")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, block, at, n_turns, formatted, spans): each conversation as blocks of whole turns, about ``BLOCK`` characters each.

    A conversation's text is its blocks' ``formatted`` by ascending ``block``; ``at`` code points stand before a block. ``spans`` are the
    code-point ranges of the conversation under the loss mask, the assistant's texts. Rows of a conversation stand by turn,
    null turns first, ties by role and text. A null text or role is empty; a null conv_id is a conversation.
    An empty text keeps its turn. Other columns are ignored. An empty table gives an empty one.
    """

    def rendered(batches):
        for batch in batches:
            out = [render(role or "", text or "") for role, text in
                   zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            learned = [role == LEARNED for role in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pc.fill_null(batch.column(2), ""), pa.array([o[0] for o in out], pa.string()),
                 pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array(learned)],
                names=["conv_id", "turn", "role", "piece", "start", "stop", "learned"])

    most = BLOCK

    def blocked(batches):
        key, block, at, size, pieces, spans = None, 0, 0, 0, [], []

        def written():
            return pa.RecordBatch.from_pydict({
                "conv_id": pa.array([key], pa.int64()), "block": pa.array([block], pa.int64()), "at": pa.array([at], pa.int64()),
                "n_turns": pa.array([len(pieces)], pa.int64()), "formatted": pa.array(["".join(pieces)], pa.string()),
                "spans": pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

        for batch in batches:
            for conv, piece, start, stop, learned in _rows(batch):
                if pieces and (conv != key or size + len(piece) > most):
                    yield written()
                    block, at = (block + 1, at + size) if conv == key else (0, 0)
                    size, pieces, spans = 0, [], []
                key = conv
                if learned:
                    spans.append({"start": at + size + start, "end": at + size + stop})
                pieces.append(piece)
                size += len(piece)
        if pieces:
            yield written()

    turn = "conv_id long, turn long, role string, piece string, start long, stop long, learned boolean"
    ordered = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").mapInArrow(
        rendered, turn).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "piece")
    return ordered.select("conv_id", "piece", "start", "stop", "learned").mapInArrow(
        blocked, "conv_id long, block long, at long, n_turns long, formatted string, spans array<struct<start: long, end: long>>")


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read from ``formatted`` and ``spans``."""

    def digests(batches):
        key, turns, loss, n, chars, size = None, None, None, 0, 0, 0

        def written():
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in ((key, pa.int64()), (n, pa.int64()), (turns.hexdigest(), pa.string()),
                                               (chars, pa.int64()), (loss.hexdigest(), pa.string()), (size, pa.int64()))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, at, formatted, spans in _rows(batch):
                if turns is None or conv != key:
                    if turns is not None:
                        yield written()
                    key, turns, loss, n, chars, size = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                if at != size:
                    raise Malformed(f"a block of conversation {conv} begins at {at}, not {size}")
                for role, text, _, _ in parse(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in spans:
                    text = unescape(formatted[span["start"] - at:span["end"] - at])
                    loss.update(text.encode())
                    chars += len(text)
                size += len(formatted)
        if turns is not None:
            yield written()

    ordered = chats.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return ordered.select("conv_id", "at", "formatted", "spans").mapInArrow(
        digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
