"""Vectorised hashes of words and word windows of many texts at once, and packed exchanges of hash sets.

A chunk of texts is one byte string with a line break after each text. Every word gets a 64-bit hash from a prefix sum of
table[byte] * BASE**place; words over LONG bytes get xxh3 instead, since such sums are only strong for short strings.
Hashes of k words are built by doubling, mixed at every step.
"""

from __future__ import annotations

import numpy as np
import xxhash

LONG = 64
BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
#: 0 for white space, 1 for all other bytes.
_SOLID = bytes(int(b not in b"\t\n\v\f\r ") for b in range(256))
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        found = []
        for base in (BASE, inverse):
            out = np.full(size, base, _U)
            out[0] = 1
            with np.errstate(over="ignore"):
                found.append(np.multiply.accumulate(out))
        _powers[:] = found
    return _powers[0], _powers[1]


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of a byte string."""
    a = np.frombuffer(raw, np.uint8)
    n = len(a)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = np.frombuffer(raw.translate(_SOLID), bool)
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(n + 1)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.multiply(np.take(_BYTES, a), up[:n], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))
    for i in np.flatnonzero(end - start > LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return h, start, end


class Chunk:
    """Word hashes of some texts: text i has the words first[i]..first[i + 1]."""

    def __init__(self, texts: list[bytes | None], lower: bool = False, places: bool = False):
        texts = [x or b"" for x in texts]
        if lower:
            texts = [x.lower() for x in texts]  # of bytes: A-Z only
        raw = b"\n".join(texts) + b"\n"
        self.hash, start, end = words_of(raw)
        ends = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
        self.first = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
        if places:
            self.raw, self.start, self.end = raw, start, end

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, width: int, seed: int = 0) -> np.ndarray:
        """Hash of the width words from each place on; places without width words in their text hold what ``valid`` excludes."""
        return windows(self.hash, width, seed)

    def valid(self, width: int) -> np.ndarray:
        """Which places start a window inside their text."""
        n = len(self.hash)
        limit = np.repeat(self.first[1:] - width, self.sizes)
        return np.arange(n) <= limit


def windows(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    n = len(h)
    if n < width:
        return np.zeros(n, _U)
    a, b = _U(0xD6E8FEB86659FD93), _U((0xA0761D6478BD642F + 2 * seed) & (2**64 - 1))
    level, size = mix(h + b), 1
    while size < width:
        step = min(size, width - size)
        level = mix(level[: len(level) - step] * a + level[step:] + b)
        size += step
    out = np.zeros(n, _U)
    out[: len(level)] = level
    return out


def chunks(texts: list[bytes | None], most: int = 1 << 20):
    """Ranges of texts of about ``most`` bytes; a longer text is alone."""
    start = held = 0
    for i, x in enumerate(texts):
        size = len(x or b"") + 1
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def planes(v: np.ndarray) -> bytes:
    """Fixed-size items byte by byte: first all first bytes; the shuffle's codec packs the planes that are mostly equal."""
    return v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()
