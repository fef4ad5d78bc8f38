"""Long repeats in a set of byte strings, from a Burrows-Wheeler transform.

The strings are laid end to end, each closed by a mark of its own that sorts before every byte. Common prefixes of
neighbouring suffixes are derived by increasing value: the queue holds the suffix intervals of strings w of one
length; every interval is extended to the left by each character c of the transform within it, which gives the interval of cw; if
the place behind that interval has no value yet, its common prefix is the length of w, and only then the interval goes on. So each place
is set once. The expansion stops when all values below the minimum length are set: the places still
open join suffixes that share at least that many bytes.
"""

from __future__ import annotations

import numpy as np

PACK = 7  # symbols of nine bits in one first sorting key


def suffix_order(symbols: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Suffix array of ``symbols`` (0 for a mark, else byte + 1), where the marks at ``marks`` are all different."""
    n = len(symbols)
    to_mark = marks[np.searchsorted(marks, np.arange(n))] - np.arange(n)
    key = np.zeros(n, np.uint64)
    padded = np.append(symbols, np.zeros(PACK, symbols.dtype)).astype(np.uint64)
    for k in range(PACK):
        key |= np.where(to_mark > k, padded[k:k + n], np.uint64(0)) << np.uint64(9 * (PACK - 1 - k))
    # stable: suffixes that end within the key stand in the order of their marks and are told apart for good
    order = np.argsort(key, kind="stable")
    ended = to_mark < PACK
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | ended[order][1:]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = PACK
    while True:
        last = np.append(new[1:], True)
        tied = np.flatnonzero(~(new & last))  # places of groups with more than one suffix
        if not len(tied):
            return order
        mine = order[tied]
        key = rank[mine] * np.int64(n + 1) + rank[np.minimum(mine + h, n - 1)]
        by = np.argsort(key, kind="stable")
        order[tied], key = mine[by], key[by]
        apart = np.ones(len(tied), bool)
        apart[1:] = key[1:] != key[:-1]
        new[tied] = apart
        rank[order[tied]] = np.maximum.accumulate(np.where(apart, tied, 0))
        h *= 2


def repeated_starts(strings: list[bytes], least: int) -> list[np.ndarray]:
    """For each string the offsets at which ``least`` bytes begin that also begin at another place of the strings."""
    lengths = np.array([len(s) for s in strings], np.int64)
    marks = np.cumsum(lengths + 1) - 1
    n = int(marks[-1]) + 1 if len(marks) else 0
    if not n:
        return []
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 1
    symbols[marks] = 0
    order = suffix_order(symbols, marks)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    left = rank[order - 1]  # the suffix one character longer; the first wraps around to the last mark
    first = np.where(symbols == 0, 0, symbols.astype(np.int64))[order]  # first character of each suffix
    mark_no = np.full(n, -1, np.int64)
    mark_no[rank[marks]] = np.arange(len(marks))
    first = np.where(mark_no >= 0, -1 - mark_no, first)  # marks differ from each other
    value = np.full(n + 1, -1, np.int64)
    value[0] = value[n] = 0
    low, high = np.array([0]), np.array([n])
    for length in range(least):
        if not len(low):
            break
        size = high - low
        total = np.cumsum(size)
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(total[-1]) - (total - size)[owner] + low[owner]
        to = left[at]
        if len(low) < len(to):
            by = np.argsort(owner * np.int64(n) + to, kind="stable")
            owner, to = owner[by], to[by]
        head = first[to]
        begins = np.ones(len(to), bool)
        begins[1:] = (owner[1:] != owner[:-1]) | (to[1:] != to[:-1] + 1) | (head[1:] != head[:-1])
        where = np.flatnonzero(begins)
        low, high = to[where], to[np.append(where[1:], len(to)) - 1] + 1
        fresh = value[high] < 0
        # two intervals may end at one place in a step; one of them goes on
        value[high[fresh]] = length
        _, keep = np.unique(high[fresh], return_index=True)
        low, high = low[fresh][keep], high[fresh][keep]
    joined = value < 0  # place i joins the suffixes i - 1 and i
    hit = joined[:n] | joined[1:]
    starts = np.sort(order[hit])
    owner = np.searchsorted(marks, starts)
    begin = marks - lengths
    return [starts[a:z] - b for a, z, b in zip(
        np.searchsorted(owner, np.arange(len(strings))), np.searchsorted(owner, np.arange(len(strings)), side="right"),
        begin, strict=True)]
