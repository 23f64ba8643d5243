"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai prefixes, merging by binary search.

Texts of one shard are laid end to end, each closed by a terminator below every byte.
Shards of bounded size keep the arrays short.  Equal windows of different shards are found
range by range: bounds taken from one shard's order are placed in all others by binary
search, and the windows between two bounds are merged together, so the work grows with
the windows and not with the pairs of shards.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bytes in a shard, and the longest lane of the Kasai pass.
SHARD, LANE = 2 << 20, 64
#: Windows that are merged at once.
RANGE = 1 << 18


def suffix_array(symbols: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """The suffix array of ``symbols`` (0 terminator, else byte + 1).

    The first sort is on seven symbols packed in a word; every round then doubles the
    sorted length by the rank of the suffix h further on, and touches only the groups that
    are not yet single.  With ``left`` (the symbols before each position's terminator)
    every terminator is a symbol of its own, in the order of the texts: suffixes of equal
    rest stand by position and are not compared into the texts that follow.
    """
    n = len(symbols)
    wide = np.zeros(n + 7, U64)
    wide[:n] = symbols
    key = np.zeros(n, U64)
    for i in range(7):
        key = (key << U64(9)) | wide[i : i + n]
    if left is not None:  # what follows a terminator does not count
        near = np.flatnonzero(left < 6)
        beyond = U64(9) * (6 - left[near]).astype(U64)
        key[near] = key[near] >> beyond << beyond
    sa = np.argsort(key).astype(np.int32)
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    rank = np.empty(n, np.int32)
    rank[sa] = head
    loose = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
    h = 7
    while len(loose):
        part = sa[loose]
        group, on = head[loose], part + h
        # past the end a shorter suffix is less, and all are below any other
        further = np.where(on < n, rank[np.minimum(on, n - 1)], n - 1 - on).astype(np.int64)
        if left is not None:
            ended = left[part] < h  # the group is of one rest
            further[ended] = part[ended]
        order = np.argsort(group.astype(np.int64) * (2 * n + 8) + further)
        part, further = part[order], further[order]
        sa[loose] = part
        split = np.ones(len(loose), bool)
        split[1:] = (group[1:] != group[:-1]) | (further[1:] != further[:-1])
        # the place of a loose group's first row is the rank of its rows
        first = np.maximum.accumulate(np.where(split, np.arange(len(loose), dtype=np.int32), 0))
        head[loose] = loose[first]
        rank[part] = head[loose]
        single = split & np.append(split[1:], True)
        loose = loose[~single]
        h *= 2
    return sa


def kasai(symbols: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Common prefix length, up to ``most``, of each suffix with the one before it in ``sa``.

    Kasai's pass in text order, where a length falls by one at most from a suffix to the
    next, run for many stretches (lanes) of the text in step.
    """
    n = len(symbols)
    lanes = -(-n // LANE)
    before = np.full(lanes * LANE, -1, np.int32)  # by text position: the suffix before it in order
    before[sa[1:]] = sa[:-1]
    before = np.ascontiguousarray(before.reshape(lanes, LANE).T)
    wide = np.zeros(lanes * LANE + most + 1, symbols.dtype)
    wide[:n] = symbols
    out = np.empty((LANE, lanes), np.int32)
    start, h = np.arange(lanes, dtype=np.int32) * LANE, np.zeros(lanes, np.int32)
    for t in range(LANE):
        i, j = start + np.int32(t), before[t]
        h = np.maximum(h - 1, 0)
        h[j < 0] = 0
        grow = np.flatnonzero((j >= 0) & (h < most))
        while len(grow):
            a = wide[i[grow] + h[grow]]
            grow = grow[(a == wide[j[grow] + h[grow]]) & (a != 0)]
            h[grow] += 1
            grow = grow[h[grow] < most]
        out[t] = h
    return np.ascontiguousarray(out.T).reshape(-1)[sa]


class Shard:
    """Distinct texts, their least documents, and the groups of equal windows among them."""

    def __init__(self, texts: list[bytes], low: np.ndarray, length: int):
        sizes = np.asarray([len(t) for t in texts], np.int64)
        flat = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + 1
        self.ends = np.cumsum(sizes + 1)
        flat[self.ends - 1] = 0
        self.length, self.symbols = length, flat
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)  # of each position
        self.begin = self.ends - sizes - 1
        left = (self.ends.astype(np.int32) - 1)[self.text] - np.arange(len(flat), dtype=np.int32)
        sa = suffix_array(flat, left)
        lcp = kasai(flat, sa, length)
        whole = left[sa] >= length
        self.at = sa[whole]  # window starts in order; equal windows stand together
        group = np.cumsum(lcp < length, dtype=np.int32)[whole]
        head = np.diff(group, prepend=-1) != 0
        self.group = np.cumsum(head, dtype=np.int32) - 1
        heads = np.flatnonzero(head)
        self.first = self.at[heads]
        owner = low[self.text[self.at]]
        self.low = np.minimum.reduceat(owner, heads) if len(heads) else owner
        self._words: np.ndarray | None = None

    @property
    def words(self) -> np.ndarray:
        """Seven symbols from each position, packed; made when shards are compared."""
        if self._words is None:
            wide = np.concatenate((self.symbols, np.zeros(self.length, np.uint16))).astype(U64)
            self._words = np.zeros(len(self.symbols), U64)
            for i in range(7):
                self._words = (self._words << U64(9)) | wide[i : i + len(self.symbols)]
        return self._words

    def places(self, mine: np.ndarray, other: Shard, low: int, high: int) -> np.ndarray:
        """For windows of this shard the first group of ``other`` between low and high that is not less, by binary search."""
        steps = self.steps()
        lo, hi = np.full(len(mine), low, np.int64), np.full(len(mine), high, np.int64)
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, max(high - 1, 0))
            less = (lo < hi) & (self._order(mine, other, other.first[mid], steps) > 0)
            hi = np.where((lo < hi) & ~less, mid, hi)
            lo = np.where(less, mid + 1, lo)
        return lo

    def steps(self) -> list[int]:
        """Offsets of the packed words that cover a window."""
        return [*range(0, self.length - 7, 7), max(0, self.length - 7)]

    def _order(self, mine: np.ndarray, other: Shard, theirs: np.ndarray, steps: list[int]) -> np.ndarray:
        out, open_ = np.zeros(len(mine), np.int8), np.arange(len(mine))
        for k in steps:
            a, b = self.words[mine[open_] + k], other.words[theirs[open_] + k]
            differ = a != b
            out[open_[differ]] = np.where(a[differ] > b[differ], 1, -1)
            open_ = open_[~differ]
        return out


def merge(shards: list[Shard], low: list[int] | None = None, high: list[int] | None = None) -> None:
    """Give equal windows of all shards their least document."""
    low = low or [0] * len(shards)
    high = high or [len(x.first) for x in shards]
    some = [k for k in range(len(shards)) if high[k] > low[k]]
    if len(some) < 2:
        return
    if sum(high[k] - low[k] for k in some) > RANGE:
        # bounds from the shard with most windows; its groups are distinct, so every part is smaller
        big = max(some, key=lambda k: high[k] - low[k])
        at = np.unique(np.linspace(low[big], high[big], 17, dtype=np.int64)[1:-1])
        at = at[at > low[big]]
        bounds = {k: at if k == big else shards[big].places(shards[big].first[at], shards[k], low[k], high[k]) for k in some}
        for i in range(len(at) + 1):
            start = [int(bounds[k][i - 1]) if i and k in bounds else low[k] for k in range(len(shards))]
            stop = [int(bounds[k][i]) if i < len(at) and k in bounds else high[k] for k in range(len(shards))]
            merge(shards, start, stop)
        return
    parts = [shards[k].words[shards[k].first[low[k] : high[k], None] + np.asarray(shards[k].steps())] for k in some]
    words = np.concatenate(parts)
    least = np.concatenate([shards[k].low[low[k] : high[k]] for k in some])
    order = np.lexsort(words.T[::-1])
    words = words[order]
    new = np.ones(len(order), bool)
    new[1:] = (words[1:] != words[:-1]).any(1)
    found = np.empty_like(least)
    found[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    at = 0
    for k in some:
        shards[k].low[low[k] : high[k]] = found[at : at + high[k] - low[k]]
        at += high[k] - low[k]


def repeated_windows(texts: list[bytes], doc: np.ndarray, length: int, shard_bytes: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first window start, number of starts): runs of windows that also lie in a smaller document's text.

    ``doc`` is each text's document.  Equal texts enter the arrays once, with their least document.
    """
    if not len(texts):
        e = np.empty(0, np.int64)
        return e, e, e
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
    low = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(low, of, doc)
    distinct = list(number)
    shards, a, size = [], 0, 0
    for b, t in enumerate(distinct):
        if size and size + len(t) > shard_bytes:
            shards.append((a, Shard(distinct[a:b], low[a:b], length)))
            a, size = b, 0
        size += len(t)
    shards.append((a, Shard(distinct[a:], low[a:], length)))
    merge([x for _, x in shards])
    # least document of every window, text by text, in text order
    which, first, starts = [], [], []
    members = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[members], np.arange(len(distinct) + 1))
    for a, s in shards:
        least = np.full(len(s.symbols), np.iinfo(np.int64).max)
        least[s.at] = s.low[s.group]
        n = len(s.begin)
        lo, hi = bounds[a : a + n], bounds[a + 1 : a + n + 1]
        # every entry of every text of this shard, with all its window starts
        entry = members[lo[0] : hi[-1]]
        own = np.repeat(np.arange(n), hi - lo)
        windows = np.maximum(s.ends[own] - 1 - s.begin[own] - length + 1, 0)
        total = int(windows.sum())
        if not total:
            continue
        offset = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
        e = np.repeat(np.arange(len(entry)), windows)
        bad = least[s.begin[own[e]] + offset] < doc[entry[e]]
        new = bad.copy()
        new[1:] &= ~bad[:-1] | (e[1:] != e[:-1])
        last = bad.copy()
        last[:-1] &= ~bad[1:] | (e[1:] != e[:-1])
        p, q = np.flatnonzero(new), np.flatnonzero(last)
        which.append(entry[e[p]])
        first.append(offset[p])
        starts.append(q - p + 1)
    if not which:
        e = np.empty(0, np.int64)
        return e, e, e
    return np.concatenate(which), np.concatenate(first), np.concatenate(starts)
