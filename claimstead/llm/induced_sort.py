"""Suffix sorting by induction, over queues that go to disk.

Suffixes are S or L as they are smaller or larger than the next one. The reduced problem orders the S*
suffixes (S after an L): their substrings up to the next S* get names in order, and the string of names is
ordered with the ranks of its own suffixes. From them all L suffixes are induced in one pass from the
smallest first symbol up, and from these all S suffixes in one pass down. Both passes take suffixes from a
priority queue of (first symbol, time of arrival) and put the suffixes that begin one place earlier back.

A pass handles all suffixes of a symbol at once, as arrays. The queue keeps one run of arrays for each
symbol; beyond a limit the runs go to one unnamed file, which the system removes with the task.
"""

from __future__ import annotations

import tempfile

import numpy as np

RESIDENT = 64 << 20
COMPARED = 1 << 16


class SymbolQueue:
    """Suffixes by first symbol, in order of arrival within a symbol."""

    def __init__(self, symbols: int, resident: int = RESIDENT):
        self.runs: list[list[np.ndarray | tuple[int, int]]] = [[] for _ in range(symbols)]
        self.resident, self.held, self.file = resident, 0, None

    def push(self, suffixes: np.ndarray, symbols: np.ndarray) -> None:
        if not len(suffixes):
            return
        order = np.argsort(symbols, kind="stable")
        suffixes, symbols = suffixes[order], symbols[order]
        starts = np.concatenate([[0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1])
        for part, symbol in zip(np.split(suffixes, starts[1:]), symbols[starts].tolist(), strict=True):
            self.runs[symbol].append(part)
        self.held += suffixes.nbytes
        if self.held > self.resident:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for run in self.runs:
            for k, part in enumerate(run):
                if isinstance(part, np.ndarray):
                    self.file.write(part.tobytes())
                    run[k] = (at, len(part))
                    at += part.nbytes
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray:
        """All suffixes of the symbol that have arrived; they leave the queue."""
        run, self.runs[symbol] = self.runs[symbol], []
        parts = []
        for part in run:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(4 * part[1]), np.int32)
            else:
                self.held -= part.nbytes
            parts.append(part)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def joined(segments: list[bytes]) -> np.ndarray:
    """The segments as symbols from 1 on, a 0 after each. UTF-8 has no bytes above 0xF4, so 0xFF stays free."""
    return np.frombuffer(b"\0".join(s.translate(_UP) for s in segments) + b"\0", np.uint8)


_UP = bytes(min(b + 1, 0xFE) for b in range(256))


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight symbols from each place on, as one number that orders as they do."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(text)]
    return out


def _refined(rank: np.ndarray, members: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Splits groups of equal rank by a second key. members: all of some groups. Returns those still in groups of several.

    A rank is the number of elements in smaller groups.
    """
    order = np.lexsort((by, rank[members])).astype(np.int32)
    members, by = members[order], by[order]
    del order
    old = rank[members]
    group = np.ones(len(members), bool)
    group[1:] = old[1:] != old[:-1]
    part = group.copy()
    part[1:] |= by[1:] != by[:-1]
    del by
    at = np.arange(len(members), dtype=np.int32)
    old += np.maximum.accumulate(np.where(part, at, np.int32(0)))
    old -= np.maximum.accumulate(np.where(group, at, np.int32(0)))
    rank[members] = old
    alone = part
    alone[:-1] &= part[1:].copy()
    return members[~alone]


def _s_star_order(text: np.ndarray, stars: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The S* suffixes in order; those of separators come first, by place, and equal no other."""
    lengths = np.append(stars[1:] + 1, len(text)).astype(np.int32) - stars
    n = len(stars)
    rank = np.zeros(n, np.int32)
    separator = text[stars] == 0
    own, others = (np.flatnonzero(x).astype(np.int32) for x in (separator, ~separator))
    rank[own] = np.arange(len(own))
    rank[others] = len(own)
    del separator, own
    first = words[stars[others]]
    short = np.clip(8 - lengths[others], 0, 7).astype(np.uint8) * np.uint8(8)
    first |= (np.uint64(1) << short) - np.uint64(1)  # a name that is another's beginning is the larger
    del short
    open_ = _refined(rank, others, first)
    del first, others
    chunk = 8
    while len(open_):
        longer = lengths[open_] > chunk
        if not longer.any():
            break
        has = np.zeros(n + 1, bool)
        has[rank[open_[longer]]] = True
        open_ = open_[has[rank[open_]]]
        left = np.clip(lengths[open_] - chunk, 0, 8)
        key = words[np.minimum(stars[open_] + chunk, len(text) - 1)]
        shift = np.minimum(8 - left, 7).astype(np.uint64) * np.uint64(8)
        key = np.where(left == 0, ~np.uint64(0), key | ((np.uint64(1) << shift) - np.uint64(1)))
        open_ = _refined(rank, open_, key)
        chunk += 8
    # the string of names: suffixes by their first 1, 2, 4 ... names
    size = np.bincount(rank, minlength=n)
    open_, step = np.flatnonzero(size[rank] > 1).astype(np.int32), 1
    del size
    while len(open_):
        open_ = _refined(rank, open_, rank[np.minimum(open_ + step, n - 1)])
        step *= 2
    order = np.empty(n, np.int32)
    order[rank] = np.arange(n, dtype=np.int32)
    return stars[order]


def _s_types(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is S; equal symbols in a row take the type of the last of them."""
    is_s = np.ones(len(text), bool)
    is_s[:-1] = text[:-1] < text[1:]
    equal = np.flatnonzero(text[:-1] == text[1:])
    if len(equal):
        last = equal[np.append(np.diff(equal) > 1, True)] + 1
        is_s[equal] = is_s[last[np.searchsorted(last, equal)]]
    return is_s


def suffix_order(text: np.ndarray, words: np.ndarray, wanted: np.ndarray | None = None, resident: int = RESIDENT) -> np.ndarray:
    """The places of all suffixes that don't begin with a separator, in order; the text is as of joined().

    wanted: a boolean for each place, where only some suffixes are of interest.
    """
    is_s = _s_types(text)
    stars = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    del is_s
    stars = _s_star_order(text, stars, words)
    bounds = np.searchsorted(text[stars], np.arange(257))
    smaller: list[list[np.ndarray]] = [[] for _ in range(256)]
    queue = SymbolQueue(256, resident)
    for c in range(256):
        batch = queue.pop(c)
        while len(batch):
            smaller[c].append(batch)
            before = batch[batch > 0] - 1
            symbol = text[before]
            queue.push(before[symbol > c], symbol[symbol > c])
            batch = before[symbol == c]
        before = stars[bounds[c] : bounds[c + 1]] - 1
        queue.push(before, text[before])
    del stars

    def of_interest(suffixes: np.ndarray) -> np.ndarray:
        return suffixes if wanted is None else suffixes[wanted[suffixes]]

    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    queue = SymbolQueue(256, resident)
    for c in range(255, 0, -1):
        batch = queue.pop(c)
        while len(batch):
            larger[c].append(of_interest(batch))
            before = batch[batch > 0] - 1
            symbol = text[before]
            queue.push(before[symbol < c], symbol[symbol < c])
            batch = before[symbol == c]
        for part in reversed(smaller[c]):
            before = part[::-1]
            before = before[before > 0] - 1
            symbol = text[before]
            queue.push(before[symbol < c], symbol[symbol < c])
        smaller[c] = [of_interest(part) for part in smaller[c]]
    parts = [p for c in range(1, 256) for p in (*smaller[c], *(x[::-1] for x in reversed(larger[c])))]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def equal_from(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a and b, both that long at least, have a common prefix of length."""
    same = np.zeros(len(a), bool)
    for low in range(0, len(a), COMPARED):
        left = np.arange(low, min(low + COMPARED, len(a)))
        for at in range(0, length, 8):
            drop = np.uint64(8 * max(0, at + 8 - length))
            left = left[words[a[left] + at] >> drop == words[b[left] + at] >> drop]
            if not len(left):
                break
        same[left] = True
    return same
