"""Suffix sorting by recursive induced sorting, in batches, on disk where memory ends, with common prefixes carried along.

Suffixes are L or S as their first unequal neighbour is smaller or larger. Those that begin a run of S (LMS) seed the order:
an L suffix is decided by its first symbols down to the next LMS suffix, an S suffix by those up to the next L
suffix. Where the textbook takes one suffix after another from a priority queue, a whole generation is one batch here: the tuples
(symbol, type, rank of the next suffix) of all suffixes at one distance from their seed are ranked together, farthest first.
LMS substrings get their names from an induction whose seeds are known by one symbol only; if names repeat,
the string of names, at most half as long, is sorted by recursion, and its ranks seed the last induction.

That last induction carries the common prefix of each suffix with the one before it: two neighbours with one symbol and type
share one symbol more than the suffixes after them, whose common prefix is the least on the way between their ranks in the generation
before; neighbours of two types share the shorter of their runs of that symbol. Seeds bring theirs from the recursion, where
equal names stand for whole substrings.

``ordered`` is the queue: it gives dense ranks to a batch of tuples. Up to ``memory`` tuples it sorts in memory, beyond it
writes sorted runs into temporary files and merges them range by range, so a batch may be far larger than memory.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY = 1 << 25


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, where each was): as one word where key and place fit into it, since numbers sort faster than places of numbers."""
    n = len(key)
    bits = max(1, (n - 1).bit_length())
    if n and int(key.max()).bit_length() + bits < 64:
        packed = key << bits
        packed |= np.arange(n)
        packed.sort()
        return packed >> bits, packed & ((1 << bits) - 1)
    order = np.argsort(key)
    return key[order], order


def _steps(ranked: np.ndarray, base: int = 0) -> np.ndarray:
    """Dense ranks of keys in order."""
    step = np.empty(len(ranked), np.int64)
    if len(ranked):
        step[0] = base
        np.cumsum(ranked[1:] != ranked[:-1], out=step[1:])
        step[1:] += base
    return step


def ordered(key: np.ndarray, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of int64 keys, not negative: (dense ranks, equal keys share one; the keys in order; where each was)."""
    n = len(key)
    out = np.empty(n, np.int64)
    if n <= memory:
        ranked, order = _sorted(key)
        out[order] = _steps(ranked)
        return out, ranked, order
    with tempfile.TemporaryDirectory(prefix="corvane-queue-") as d:
        runs, sample = [], []
        for k, start in enumerate(range(0, n, memory)):
            part, order = _sorted(np.asarray(key[start : start + memory]))
            keys = np.memmap(f"{d}/k{k}", np.int64, "w+", shape=(len(part),))
            items = np.memmap(f"{d}/i{k}", np.int64, "w+", shape=(len(part),))
            keys[:], items[:] = part, order + start
            runs.append((keys, items))
            sample.append(part[:: max(1, len(part) // 256)])
        rims = np.unique(np.concatenate(sample))
        rims = rims[:: max(1, len(rims) * memory // (2 * n))]
        base, done, at = 0, 0, [0] * len(runs)
        key, places = np.empty(n, np.int64), np.empty(n, np.int64)
        for rim in [*rims[1:].tolist(), None]:
            ends = [len(k) if rim is None else int(np.searchsorted(k, rim)) for k, _ in runs]
            ranked, order = _sorted(np.concatenate([k[a:b] for (k, _), a, b in zip(runs, at, ends, strict=True)]))
            items = np.concatenate([i[a:b] for (_, i), a, b in zip(runs, at, ends, strict=True)])[order]
            if len(ranked):
                step = _steps(ranked, base)
                out[items] = step
                base = int(step[-1]) + 1
                key[done : done + len(ranked)], places[done : done + len(ranked)] = ranked, items
                done += len(ranked)
            at = ends
        return out, key, places


def ranks(key: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    return ordered(key, memory)[0]


class Least:
    """Minimum of values[a + 1 : b + 1] for arrays a < b, by a table of the minima of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray, cap: int):
        n = len(values)
        levels = max(1, n.bit_length())
        self.table = np.empty(n * levels, np.uint16 if cap < 1 << 16 else np.int32)
        self.values, self.stride = self.table[:n], n
        self.values[:] = values
        for j in range(1, levels):
            last, step = self.table[(j - 1) * n : j * n], 1 << (j - 1)
            np.minimum(last[: n - step], last[step:], out=self.table[j * n : (j + 1) * n - step])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a).astype(np.float64))[1].astype(np.int64) - 1
        row = level * self.stride + 1
        return np.minimum(self.table[row + a], self.table[row + b - (1 << level)]).astype(np.int32)


class Text:
    """What a text's inductions share."""

    def __init__(self, text: np.ndarray, cap: int):
        n = self.n = len(text)
        self.text, self.cap = text, cap
        self.shift = n.bit_length()  # a tuple is symbol, type and a rank in this many bits
        self.high = text << (self.shift + 1)
        differ = _next(np.append(text[:-1] != text[1:], False))
        self.small = np.ones(n, bool)
        self.small[:-1] = text[differ[:-1]] < text[differ[:-1] + 1]
        self.run = np.minimum(differ + 1 - np.arange(n), cap).astype(np.int32)  # of equal symbols from here on
        self.run[-1] = 1
        self.lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1


def _next(flags: np.ndarray) -> np.ndarray:
    """The first place from each on where flags holds; len(flags) if none."""
    at = np.where(flags, np.arange(len(flags)), len(flags))
    return np.minimum.accumulate(at[::-1])[::-1]


def _neighbours(t: Text, at: np.ndarray, order: np.ndarray, ranked: np.ndarray, own: int, inner: Least | None, outer: Least) -> np.ndarray:
    """Common prefixes of the suffixes at[order], whose tuples are ``ranked``, each with the one before. Ranks in tuples of the generation's
    own type are those of the generation before, in others those of seeds."""
    out = np.zeros(len(ranked), np.int32)
    kind = ranked >> t.shift
    same = np.flatnonzero((kind[1:] ^ kind[:-1]) < 2) + 1
    low, mine = ranked & ((1 << t.shift) - 1), (kind & 1) == own
    a, b = mine[same - 1], mine[same]
    k = same[a != b]
    out[k] = np.minimum(t.run[at[order[k - 1]]], t.run[at[order[k]]])
    k = same[~a & ~b]
    if len(k):
        out[k] = outer.between(low[k - 1], low[k])
    k = same[a & b]
    if len(k):
        out[k] = np.minimum(t.cap, 1 + inner.between(low[k - 1], low[k]))
    return out


def _generations(t: Text, first, depth, seed_rank, own: int, memory: int, seeds: Least):
    """Ranks of the suffixes ``first``, all of type ``own`` (0 for L, 1 for S), whose seeds are ``depth`` places on, and the common
    prefixes of the ranked suffixes, from those of the seeds."""
    most = int(depth.max()) if len(depth) else 0
    order = np.argsort((most - depth).astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")  # places stay in order
    start, far = first[order], depth[order]
    alive = np.searchsorted(-far, -np.arange(most + 1), side="right")  # how many reach at least that far
    now, inner = np.zeros(0, np.int64), None
    for j in range(most, -1, -1):
        n, old = int(alive[j]), len(now)
        if j == 0:
            n = old
        at = start[:n] + j
        key = np.take(t.high, at)
        key[:old] += now
        if own:
            key[:old] += 1 << t.shift
        if n > old:  # those whose seed is here
            key[old:] += seed_rank[at[old:]] + ((1 - own) << t.shift)
        now, ranked, place = ordered(key, memory)  # ranks are distinct here
        inner = Least(_neighbours(t, at, place, ranked, own, inner, seeds), t.cap)
    out = np.empty(len(first), np.int64)
    out[order] = now
    return out, inner


def _induce(t: Text, lms_rank, memory: int, seeds: Least):
    """Ranks of all L suffixes and of all S suffixes but the end mark, by place, from ranks of the LMS suffixes by place."""
    large, rest = np.flatnonzero(~t.small), np.flatnonzero(t.small[:-1])
    rank, s_rank = np.zeros(t.n, np.int64), np.zeros(t.n, np.int64)
    rank[large], l_common = _generations(t, large, _next(t.small)[large] - large, lms_rank, 0, memory, seeds)
    found, s_common = _generations(t, rest, _next(~t.small)[rest] - rest, rank, 1, memory, l_common)
    s_rank[rest] = found + 1
    return rank, s_rank, l_common, s_common


def _names(t: Text, typed: np.ndarray, memory: int) -> np.ndarray:
    """Ranks of the LMS substrings, equal ones sharing one: symbols and types from each LMS suffix to the next, induced from that one's
    first symbol. The end mark is the least."""
    first, depth = t.lms[:-1], np.diff(t.lms)
    if not len(first):
        return np.zeros(1, np.int64)
    most = int(depth.max())
    order = np.argsort((most - depth).astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")
    start, far = first[order], depth[order]
    alive = np.searchsorted(-far, -np.arange(most + 1), side="right")
    now = np.zeros(0, np.int64)
    for j in range(most, -1, -1):
        key = np.take(typed, start[: int(alive[j])] + j)
        key[: len(now)] += now
        now = ranks(key, memory)
    out = np.zeros(len(t.lms), np.int64)
    out[order] = now + 1
    return out


def _compare(t: Text, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Common prefixes of suffixes a and b that are known to share ``start`` symbols."""
    out = np.minimum(start, t.cap)
    alive = np.flatnonzero(out < t.cap)
    while len(alive):
        same = t.text[a[alive] + out[alive]] == t.text[b[alive] + out[alive]]  # the end mark differs from all
        alive = alive[same]
        out[alive] += 1
        alive = alive[out[alive] < t.cap]
    return out


def suffix_order(text: np.ndarray, cap: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(the place of every suffix in the order of all, for every place the symbols shared with the suffix before, up to cap).

    text: int64, not negative, its last symbol the only 0."""
    n = len(text)
    if n >= 1 << 29:
        raise ValueError("a text of 2**29 symbols or more must be cut into several")
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int32)
    t = Text(text, cap)
    # Seeds known by their symbol alone give names to LMS substrings.
    typed = t.high + (t.small.astype(np.int64) << t.shift)
    names = _names(t, typed, memory)
    m = len(names)
    if int(names.max()) + 1 < m:
        names, shared = suffix_order(names, cap // 2 + 1, memory)
    else:
        shared = np.zeros(m, np.int32)
    order = np.empty(m, np.int64)
    order[names] = np.arange(m)
    # Equal names are equal substrings: what they span is shared, the rest is looked at.
    spanned = t.lms[np.minimum(order[1:] + shared[1:], m - 1)] - t.lms[order[1:]]
    common = np.zeros(m, np.int32)
    common[1:] = _compare(t, t.lms[order[:-1]], t.lms[order[1:]], spanned)
    seeds = np.zeros(n, np.int64)
    seeds[t.lms] = names
    l_rank, s_rank, l_common, s_common = _induce(t, seeds, memory, Least(common, cap))
    rank, _, at = ordered(typed + np.where(t.small, s_rank, l_rank), memory)
    # Neighbours of one symbol and type are neighbours among their type's suffixes.
    out = np.zeros(n, np.int32)
    kind, symbol = t.small[at], text[at]
    same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
    mixed = same[kind[same] != kind[same - 1]]
    out[mixed] = np.minimum(t.run[at[mixed - 1]], t.run[at[mixed]])
    both = same[kind[same] == kind[same - 1]]
    large, little = both[~kind[both]], both[kind[both]]
    if len(large):
        out[large] = l_common.values[l_rank[at[large]]]
    if len(little):
        out[little] = s_common.values[s_rank[at[little]] - 1]
    return rank, out
