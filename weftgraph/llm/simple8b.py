"""Simple-8b word-aligned coding of token ids, vectorised with numpy.

A 64-bit word holds a selector in its low four bits and, above it, as many ids of one width as fit in 60 bits:
from 60 ids of one bit to one id of 60 bits. Each word takes the largest count whose ids all fit. Ids of more than
60 bits stand in an escape list; their word (selector 15) holds the place in that list. Blocks of ``BLOCK`` ids are
coded on their own and the file lists where each block's words begin, so blocks are coded and decoded side by side,
and a reader may start at any block.

File image, little-endian: magic ``S8B1``, then as 64-bit integers the block length, the numbers of ids,
blocks, words, escapes and documents; then the arrays: first word of each block, words, escapes, document ids, a byte
for each that is 1 where the id is null, and ids per document.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"S8B1"
BLOCK = 1024
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
_HELD = np.append(COUNTS, [1, 1])  # ids in a word, by selector; 14 is not used


def _bits(ids: np.ndarray) -> np.ndarray:
    limits = np.uint64(1) << np.arange(1, 64, dtype=np.uint64)
    if len(ids) and int(ids.max()) < 1 << 16:
        by_id = np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8) + np.uint8(1)
        return by_id[ids]
    return np.searchsorted(limits, ids.astype(np.uint64), side="right").astype(np.uint8) + np.uint8(1)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place, the selector of a word that began there."""
    most = bits.copy()
    chosen = np.where(bits > 60, ESCAPE, 13).astype(np.uint8)
    for n in range(2, 61):
        if n > len(bits):
            break
        # most[i] is the largest width among the n ids from i; past the end nothing is asked for
        np.maximum(most[: len(bits) - n + 1], bits[n - 1:], out=most[: len(bits) - n + 1])
        at = np.flatnonzero(COUNTS == n)
        if len(at):
            fits = most <= WIDTHS[at[0]]
            if not fits.any():
                if n >= 8:
                    break
                continue
            chosen[fits] = at[0]
    return chosen


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each block and one past the last, words, escapes)."""
    n, blocks = len(ids), -(-len(ids) // block)
    padded = np.zeros(blocks * block, np.uint64)
    padded[:n] = ids
    chosen = np.full(blocks * block, 13, np.uint8)
    flat = _bits(padded)
    chosen[:] = _selectors(flat)
    # a word that crosses the end of its block is cut there: only the ids up to the end count
    at = np.arange(blocks) * block
    ends = np.minimum(at + block, n)
    starts, owners = [], []
    live = np.arange(blocks)
    while len(live):
        here = at[live]
        starts.append(here)
        owners.append(live)
        at[live] = here + _HELD[chosen[here]]
        live = live[at[live] < ends[live]]
    if not blocks:
        return np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    start = np.sort(np.concatenate(starts))
    firsts = np.append(np.searchsorted(start, np.arange(blocks) * block), len(start)).astype(np.int64)
    selector = chosen[start]
    out = selector.astype(np.uint64)
    padded = np.append(padded, np.zeros(60, np.uint64))
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(selector == s)
        for k in range(count if len(mine) else 0):
            value = padded[start[mine] + k]
            if width < 60:  # ids of the next block are not this word's: they are masked off and not read
                value = value & np.uint64((1 << int(width)) - 1)
            out[mine] |= value << np.uint64(4 + k * int(width))
    far = np.flatnonzero(selector == ESCAPE)
    out[far] |= np.arange(len(far), dtype=np.uint64) << np.uint64(4)
    return firsts, out, padded[start[far]]


def decode(firsts: np.ndarray, words: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words & np.uint64(15)).astype(np.uint8)
    before = np.append(0, np.cumsum(_HELD[selector]))
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    place = before[:-1] - before[firsts[:-1]][owner] + owner * block
    end = np.minimum((owner + 1) * block, n)
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(selector == s)
        for k in range(count if len(mine) else 0):
            to = place[mine] + k
            inside = to < end[mine]
            out[to[inside]] = (words[mine[inside]] >> np.uint64(4 + k * int(width))) & np.uint64((1 << int(width)) - 1)
    far = np.flatnonzero(selector == ESCAPE)
    out[place[far]] = escapes[(words[far] >> np.uint64(4)).astype(np.int64)]
    return out


def to_file(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> bytes:
    firsts, words, escapes = encode(ids, block)
    head = np.array([block, len(ids), len(firsts) - 1, len(words), len(escapes), len(lengths)], "<i8")
    parts = (head, firsts.astype("<i8"), words.astype("<u8"), escapes.astype("<u8"), doc_ids.astype("<i8"),
             nulls.astype("u1"), lengths.astype("<i8"))
    return MAGIC + b"".join(p.tobytes() for p in parts)


def from_file(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, document ids, which of them are null, ids per document)."""
    if image[:4] != MAGIC:
        raise ValueError("not a token file")
    at = 4

    def take(kind, n):
        nonlocal at
        found = np.frombuffer(image, kind, n, at)
        at += found.nbytes
        return found

    block, n, blocks, words, escapes, docs = map(int, take("<i8", 6))
    firsts, coded, far = take("<i8", blocks + 1), take("<u8", words), take("<u8", escapes)
    return decode(firsts, coded, far, n, block), take("<i8", docs), take("u1", docs).astype(bool), take("<i8", docs)
