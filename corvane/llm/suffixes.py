"""Operator 8: removal of byte strings of WIDTH bytes that occur again, by suffix sorting with external induction.

Texts are cut into pieces so that equal strings meet in one suffix sort. Every window of WIDTH bytes belongs to the
smallest of its GRAM-byte strings (by a hash of their first bytes; leftmost of equal ones), so equal windows belong to equal
grams at equal offsets; only grams that occur twice in the corpus matter (first exchange). A piece is the consecutive
windows of one gram whose offsets fall into one range of SPAN: they all hold the same core of WIDTH - SPAN + 1
bytes, and only pieces whose core occurs twice matter (second exchange). Those are sent to the bucket of their core, equal pieces
once for each shard, with a weight. The pieces of a bucket are one text for ``induction.suffix_order``, which carries
common prefixes up to WIDTH bytes along: windows that equal a neighbour, or whose piece has a weight over 1, go.
Answers are bits for each window and return to the shards. Pieces of one core over SORT_BYTES are cut by longer cores.

Null text is empty; texts under WIDTH bytes lose nothing; repeated rows are repeats of each other; an empty table gives no
rows; matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from corvane.llm.common import documents, extended, lean, materialize
from corvane.llm.induction import suffix_order
from corvane.llm.shards import Keys, Shards, text_of, unpack_docs
from corvane.llm.wordhash import chunks, mix, planes, unplanes

WIDTH, GRAM = 400, 96
SEGMENT = 1 << 25
SPAN = 102
#: Bytes of pieces in one suffix sort, about.
SORT_BYTES = 1 << 19
#: Tuples of a sort's queue that stay in memory; those of a larger batch go through sorted runs on the task's disk.
MEMORY = 1 << 17
_U = np.uint64
_PLACE = 26  # bits of a place in a segment group


def span_of(width: int) -> int:
    return min(SPAN, width // 4 + 2)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of v[i:i + width] for every i that has width values."""
    n = len(v)
    rows = -(-n // width)
    padded = np.full(rows * width, ~_U(0), _U)
    padded[:n] = v
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Pieces:
    """Of some texts: gram k, at[k] in ``raw`` with hash key[k], owns the windows from low[k] to high[k]."""

    def __init__(self, texts: list[bytes], width: int, gram: int, noted: np.ndarray | None = None):
        self.raw = raw = b"".join(texts)
        n, none = len(raw), np.zeros(0, np.int64)
        self.low, self.high, self.at, self.key = none, none, none, np.zeros(0, _U)
        if noted is not None:
            self.low, self.high, self.at, self.key = *(noted[k].astype(np.int64) for k in ("low", "high", "at")), noted["key"]
            return
        if n < width:
            return
        padded = raw + bytes(8)
        eight = np.ndarray((n,), "<u8", padded, strides=(1,))
        value = ((eight * _U(0x9FB21C651E98DF25)) ^ _U(0x5851F42D4C957F2D)) * _U(0xBF58476D1CE4E5B9)
        value = (value & ~_U((1 << _PLACE) - 1)) | np.arange(n, dtype=_U)
        least = sliding_min(value[: n - gram + 1], width - gram + 1)
        ends = np.cumsum([len(t) for t in texts])
        sizes = np.array([len(t) for t in texts])
        inside = np.arange(len(least)) + width <= np.repeat(ends, sizes)[: len(least)]
        owner = (least & _U((1 << _PLACE) - 1)).astype(np.int64)
        owner[~inside] = -1
        rim = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        low = np.concatenate([[0], rim])
        high = np.concatenate([rim, [len(owner)]]) - 1
        real = owner[low] >= 0
        self.low, self.high = low[real], high[real]
        self.at = at = owner[self.low]
        h = np.zeros(len(at), _U)
        for k in range(0, gram, 8):
            h = mix(h * _U(0x9E3779B97F4A7C15) + eight[at + k])
        self.key = h


_NOTE = np.dtype([("low", "<u4"), ("high", "<u4"), ("at", "<u4"), ("key", "<u8")])


def unpack_note(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    sizes = np.frombuffer(raw, "<u4", int(np.frombuffer(raw, "<u4", 1)[0]), 4).tolist()
    at, out = 4 + 4 * len(sizes), []
    for n in sizes:
        out.append(unplanes(raw[at : at + n * _NOTE.itemsize], _NOTE) if n else np.zeros(0, _NOTE))
        at += n * _NOTE.itemsize
    return out


class Texts:
    """The pieces of a shard, in the order of its texts; texts over SEGMENT bytes are cut, with overlap."""

    def __init__(self, texts: list[bytes | None], width: int, gram: int, note: bytes | None = None):
        self.width, self.sizes = width, np.array([len(t or b"") for t in texts], np.int64)
        cut, offset = [], []  # segments and where they begin among all bytes
        base = 0
        for t in texts:
            t = t or b""
            for a in range(0, max(1, len(t)), SEGMENT):
                cut.append(t[a : a + SEGMENT + width - 1] if len(t) > SEGMENT else t)
                offset.append(base + a)
            base += len(t)
        self.total, groups = base, []
        known = unpack_note(note) if note else None
        for k, (a, b) in enumerate(chunks(cut)):
            p = Pieces(cut[a:b], width, gram, known[k] if known else None)
            lengths = np.array([len(x) for x in cut[a:b]], np.int64)
            firsts = np.cumsum(lengths) - lengths
            part = np.searchsorted(firsts, p.low, side="right") - 1
            groups.append((p, np.array(offset[a:b], np.int64)[part] - firsts[part]))
        self.groups = groups
        self.key = np.concatenate([p.key for p, _ in groups]) if groups else np.zeros(0, _U)

    def note(self) -> bytes:
        """The grams, to be kept beside the shard: finding them is most of a pass."""
        parts = []
        for p, _ in self.groups:
            grams = np.zeros(len(p.key), _NOTE)
            grams["low"], grams["high"], grams["at"], grams["key"] = p.low, p.high, p.at, p.key
            parts.append(grams)
        head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
        return zstandard.ZstdCompressor(1).compress(head + b"".join(planes(g) for g in parts))

    def anchors(self, buckets: int) -> Keys:
        return Keys(self.key, None, np.ones(len(self.key), bool), buckets)

    def cores(self, yes: np.ndarray, buckets: int) -> Keys:
        """Keys of the cores of all pieces of the wanted grams, whose place is kept in ``pieces``."""
        self.pieces, core = [], []
        width, span, n = self.width, span_of(self.width), 0
        for p, move in self.groups:
            some = np.flatnonzero(yes[n : n + len(p.key)])
            n += len(p.key)
            for at, low, high, shift in zip(p.at[some].tolist(), p.low[some].tolist(), p.high[some].tolist(), move[some].tolist(), strict=True):
                for q in range((at - high) // span, (at - low) // span + 1):
                    a, b, c = max(low, at - (q + 1) * span + 1), min(high, at - q * span), at - q * span
                    core.append(xxhash.xxh3_64_intdigest(p.raw[c : c + width - span + 1], q))
                    self.pieces.append((p.raw, a, b + width, shift, at - a))
        self.core = np.array(core, _U)
        return Keys(self.core, None, np.ones(len(core), bool), buckets)

    def wanted(self, yes: np.ndarray, buckets: int):
        """Unique wanted pieces by bucket: {bucket: [(core, content, offset of the gram, [where each begins among all bytes])]}."""
        shift = 64 - (buckets - 1).bit_length()
        found: dict[tuple[int, bytes, int], list[int]] = {}
        for k in np.flatnonzero(yes).tolist():
            raw, a, b, move, offset = self.pieces[k]
            found.setdefault((int(self.core[k]), raw[a:b], offset), []).append(a + move)
        out: dict[int, list] = {}
        for (core, content, offset), places in sorted(found.items()):
            out.setdefault(core >> shift, []).append((core, content, offset, places))
        return out

    def covered(self, starts: np.ndarray) -> np.ndarray:
        change = np.zeros(self.total + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.width, -1)
        return np.cumsum(change)[:-1] > 0


def pack(pieces: list) -> bytes:
    n = np.array([len(pieces)], "<u4").tobytes()
    cores, contents, offsets, places = zip(*pieces, strict=True)
    head = [np.array(cores, "<u8"), np.array([len(c) for c in contents], "<u4"), np.array(offsets, "<u2"), np.array([len(p) > 1 for p in places], np.uint8)]
    return zstandard.ZstdCompressor(3).compress(n + b"".join(x.tobytes() for x in head) + b"".join(contents))


def unpack(raw: bytes):
    """[(core, content, offset, weight)]"""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    cores, sizes = np.frombuffer(raw, "<u8", n, 4), np.frombuffer(raw, "<u4", n, 4 + 8 * n).astype(np.int64)
    offsets, twice = np.frombuffer(raw, "<u2", n, 4 + 12 * n), np.frombuffer(raw, np.uint8, n, 4 + 14 * n)
    ends = 4 + 15 * n + np.cumsum(sizes)
    return [(k, raw[e - s : e], o, t + 1) for k, e, s, o, t in zip(cores.tolist(), ends.tolist(), sizes.tolist(), offsets.tolist(), twice.tolist(), strict=True)]


def repeated_windows(pieces: list[bytes], width: int, memory: int = MEMORY) -> list[np.ndarray]:
    """For every window of every piece whether another window of the pieces equals it."""
    raw = b"\0".join(pieces) + b"\0"
    sizes = np.array([len(p) for p in pieces], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(len(raw) + 1, np.int64)
    text[:-1] = np.frombuffer(raw, np.uint8)
    text[:-1] += 2
    text[first + sizes] = 1  # after each piece
    rank, common = suffix_order(text, width, memory)
    # A suffix that shares width bytes with a neighbour starts a window: no piece's end is among them.
    equal = common >= width
    equal[:-1] |= equal[1:].copy()
    hit = equal[rank]
    return [hit[f : f + s - width + 1] for f, s in zip(first, sizes, strict=True)]


def group_windows(group: list[tuple[bytes, int]], width: int, span: int, out: dict, memory: int = MEMORY) -> list:
    """Jobs for suffix sorts of one core's pieces (content, offset): [(pieces, where their windows go in ``out``)].

    A group over SORT_BYTES is cut by the cores of shorter ranges, at last by whole windows, which are equal as they stand."""
    if sum(len(c) for c, _ in group) <= SORT_BYTES:
        return [[(c, out[c, o], 0) for c, o in group]]
    span = max(1, span // 8)
    cut: dict[tuple[int, bytes], dict] = {}
    for c, o in group:
        for q in range((o - (len(c) - width)) // span, o // span + 1):
            a, b, at = max(0, o - (q + 1) * span + 1), min(len(c) - width, o - q * span), o - q * span
            cut.setdefault((q, c[at : at + width - span + 1]), {}).setdefault((c[a : b + width], o - a), []).append((out[c, o], a))
    jobs = []
    for parts in cut.values():
        inner = {k: np.zeros(len(k[0]) - width + 1, bool) for k in parts}
        if len(parts) > 1:
            for job in group_windows(list(parts), width, span, inner, memory):
                _run([job], width, memory)
        for k, places in parts.items():
            for flags, a in places:
                flags[a : a + len(inner[k])] |= inner[k] | (len(places) > 1)
    return jobs


def _run(jobs: list, width: int, memory: int) -> None:
    """One suffix sort of several jobs' pieces; equal windows of different jobs have different cores, so none are."""
    pieces = [x for job in jobs for x in job]
    for (_, flags, a), found in zip(pieces, repeated_windows([c for c, _, _ in pieces], width, memory), strict=True):
        flags[a : a + len(found)] |= found


def _sort(width: int, memory: int):
    """All shards' pieces of a bucket -> a bit for each window, in the order in which each shard sent its pieces."""

    def run(table: pa.Table) -> pa.Table:
        shards, bucket = table["shard"].to_pylist(), table["bucket"][0].as_py()
        sent = [unpack(x) for x in table["keys"].to_pylist()]
        weight: dict[tuple[int, bytes, int], int] = {}
        for pieces in sent:
            for core, c, o, t in pieces:
                weight[core, c, o] = weight.get((core, c, o), 0) + t
        groups: dict[int, list] = {}
        for core, c, o in weight:
            groups.setdefault(core, []).append((c, o))
        flags = {k: np.full(len(k[1]) - width + 1, n > 1) for k, n in weight.items()}
        jobs, size = [], 0
        for core, group in sorted(groups.items()):
            if len(group) > 1:
                for job in group_windows(group, width, span_of(width), {(c, o): flags[core, c, o] for c, o in group}, memory):
                    jobs.append(job)
                    size += sum(len(c) for c, _, _ in job)
                    if size >= SORT_BYTES:
                        _run(jobs, width, memory)
                        jobs, size = [], 0
        if jobs:
            _run(jobs, width, memory)
        bits = [np.packbits(np.concatenate([flags[core, c, o] for core, c, o, _ in pieces])).tobytes() for pieces in sent]
        return pa.table({"shard": pa.array(shards, pa.int64()), "bucket": pa.array([bucket] * len(shards), pa.int32()), "bits": pa.array(bits, pa.binary())})

    return run


def _ask_anchors(buckets: int):
    @lean
    def run(batches):
        for batch in batches:
            for shard, note in zip(batch["shard"].to_pylist(), batch["note"].to_pylist(), strict=True):
                key = np.concatenate([g["key"] for g in unpack_note(note)])
                yield Keys(key, None, np.ones(len(key), bool), buckets).rows(shard, buckets)

    return run


def _ask_cores(width: int, gram: int, buckets: int):
    @lean
    def run(batches):
        for batch in batches:
            for shard, raw, note, grams in zip(*(batch[k].to_pylist() for k in ("shard", "docs", "note", "answer0")), strict=True):
                t = Texts(text_of(unpack_docs(raw)), width, gram, note)
                yield t.cores(t.anchors(buckets).answered(grams), buckets).rows(shard, buckets)

    return run


def _wanted(texts: list[bytes | None], note: bytes, grams, cores, width: int, gram: int, buckets: int):
    t = Texts(texts, width, gram, note)
    return t, t.wanted(t.cores(t.anchors(buckets).answered(grams), buckets).answered(cores), buckets)


def _send_pieces(width: int, gram: int, buckets: int):
    @lean
    def run(batches):
        for batch in batches:
            for shard, raw, note, grams, cores in zip(*(batch[k].to_pylist() for k in ("shard", "docs", "note", "answer0", "answer1")), strict=True):
                _, wanted = _wanted(text_of(unpack_docs(raw)), note, grams, cores, width, gram, buckets)
                if wanted:
                    yield pa.RecordBatch.from_arrays([pa.array(list(wanted), pa.int32()), pa.array([shard] * len(wanted), pa.int64()), pa.array([pack(x) for x in wanted.values()], pa.binary())], names=["bucket", "shard", "keys"])

    return run


def _apply(width: int, gram: int, buckets: int, names: list[str], make):
    @lean
    def run(batches):
        for batch in batches:
            for raw, note, grams, cores, found in zip(*(batch[k].to_pylist() for k in ("docs", "note", "answer0", "answer1", "answer2")), strict=True):
                docs = unpack_docs(raw)
                texts = text_of(docs)
                t, wanted = _wanted(texts, note, grams, cores, width, gram, buckets)
                starts = [np.zeros(0, np.int64)]
                for x in found or ():
                    pieces = wanted[x["bucket"]]
                    sizes = [len(c) - width + 1 for _, c, _, _ in pieces]
                    flags = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=sum(sizes)).astype(bool)
                    at = 0
                    for (_, _, _, places), n in zip(pieces, sizes, strict=True):
                        hit = np.flatnonzero(flags[at : at + n])
                        starts += [hit + p for p in places] if len(hit) else []
                        at += n
                gone = t.covered(np.concatenate(starts))
                removed, spans, kept, at = [], [], [], 0
                for text in texts:
                    cut = gone[at : at + len(text or b"")]
                    at += len(cut)
                    n = int(cut.sum())
                    removed.append(n)
                    spans.append(int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if n else 0)
                    kept.append(np.frombuffer(text, np.uint8)[~cut].tobytes() if n else text or b"")
                yield from pa.table([*docs.columns, *make(t.sizes, removed, spans, kept)], names=names).to_batches()

    return run


def _remove(docs: DataFrame, width: int, gram: int, added: dict[str, str], make, memory: int, drop: tuple[str, ...] = ()) -> DataFrame:
    docs = docs.drop(*added)
    schema = extended(docs, **added)
    asked = "bucket int, shard long, keys binary"
    with Shards(docs, note=lambda texts: Texts(texts, width, gram).note()) as shards:
        n = shards.buckets
        anchors = shards.exchange(shards.rows().select("shard", "note").mapInArrow(_ask_anchors(n), asked), "anchors")
        cores = shards.exchange(shards.rows(anchors).mapInArrow(_ask_cores(width, gram, n), asked), "cores")
        pieces = shards.rows(anchors, cores).mapInArrow(_send_pieces(width, gram, n), asked)
        found = materialize(pieces.groupBy("bucket").applyInArrow(_sort(width, memory), "shard long, bucket int, bits binary"), "suffixes")
        out = shards.rows(anchors, cores, found).mapInArrow(_apply(width, gram, n, schema.names, make), schema)
        return materialize(out.drop(*drop), "suffix-out")


def remove_repeats(docs: DataFrame, width: int = WIDTH, memory: int = MEMORY) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary: what stays of the text's bytes); columns with these names are replaced."""

    def make(n, removed, spans, kept):
        return [pa.array(n), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]

    return _remove(docs, width, _gram(width), {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}, make, memory)


def _gram(width: int) -> int:
    return min(GRAM, max(8, width // 4 // 8 * 8))


def digests(docs: DataFrame, width: int = WIDTH, memory: int = MEMORY) -> DataFrame:
    def make(n, removed, spans, kept):
        return [pa.array(n), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]

    added = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    return _remove(docs.select("doc_id", "text"), width, _gram(width), added, make, memory, ("text",))


def op8_suffix_dedup(spark, sf_dir: str, memory: int = MEMORY) -> DataFrame:
    return digests(documents(spark, sf_dir), memory=memory)
