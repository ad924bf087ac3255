"""Operator 4: removal of repeated word windows through fixed-block anchors.

A window of WIDTH words holds a whole block of BLOCK = (WIDTH + 1) // 2 words of the grid of its document, wherever it
starts. So non-overlapping blocks are the index, every rolling window of BLOCK words is a probe, and a probe that equals a
block elsewhere is an anchor (first exchange; coarse keys may pass a few too many, never too few). Around each anchor all
WIDTH-word windows that contain it are compared by 96-bit hashes (second exchange): consecutive ones that occur
elsewhere are a maximal exact repeat, and all its words go.

Null text has no words; texts under WIDTH words lose none; repeated rows are repeats of each other; an empty table gives
no rows. Other columns of the documents stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import documents, extended, lean, materialize
from corvane.llm.shards import Keys, Shards, text_of, unpack_docs
from corvane.llm.wordhash import Chunk, chunks

WIDTH = 35


class _Windows:
    """Of one shard: all places of its words in a row, text after text."""

    def __init__(self, texts: list[bytes | None], width: int):
        block = (width + 1) // 2
        probe, wide, low, marked, valid, wide_valid, sizes = [], [], [], [], [], [], []
        for a, b in chunks(texts):
            c = Chunk(texts[a:b])
            place = np.arange(len(c.hash)) - np.repeat(c.first[:-1], c.sizes)
            probe.append(c.windows(block))
            wide.append(c.windows(width, 1))
            low.append((c.windows(width, 2) >> np.uint64(32)).astype(np.uint32))
            marked.append(place % block == 0)
            # Texts too short for a window of the full width can't repeat one.
            valid.append(c.valid(block) & np.repeat(c.sizes >= width, c.sizes))
            wide_valid.append(c.valid(width))
            sizes.append(c.sizes)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.wide, self.low, self.wide_valid, self.sizes = join(wide, np.uint64), join(low, np.uint32), join(wide_valid, bool), join(sizes, np.int64)
        self.at = np.flatnonzero(join(valid, bool))
        self.probe, self.marked = join(probe, np.uint64)[self.at], join(marked, bool)[self.at]
        self.block, self.width = block, width

    def anchors(self, buckets: int) -> Keys:
        return Keys(self.probe, None, self.marked, buckets)

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Starts of full windows that contain an anchor, given which probes are anchors."""
        change = np.zeros(len(self.wide) + 1, np.int64)
        at = self.at[hit]
        np.add.at(change, np.maximum(at - (self.width - self.block), 0), 1)
        np.add.at(change, at + 1, -1)
        return np.flatnonzero((np.cumsum(change)[:-1] > 0) & self.wide_valid)

    def repeats(self, starts: np.ndarray, buckets: int) -> Keys:
        return Keys(self.wide[starts], self.low[starts], np.ones(len(starts), bool), buckets)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        change = np.zeros(len(self.wide) + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.width, -1)
        return np.cumsum(change)[:-1] > 0


def _ask_anchors(width: int, buckets: int):
    @lean
    def run(batches):
        for batch in batches:
            for shard, raw in zip(batch["shard"].to_pylist(), batch["docs"].to_pylist(), strict=True):
                yield _Windows(text_of(unpack_docs(raw)), width).anchors(buckets).rows(shard, buckets)

    return run


def _ask_repeats(width: int, buckets: int):
    @lean
    def run(batches):
        for batch in batches:
            for shard, raw, anchors in zip(batch["shard"].to_pylist(), batch["docs"].to_pylist(), batch["answer0"].to_pylist(), strict=True):
                w = _Windows(text_of(unpack_docs(raw)), width)
                starts = w.candidates(w.anchors(buckets).answered(anchors))
                if len(starts):
                    yield w.repeats(starts, buckets).rows(shard, buckets)

    return run


def _apply(width: int, buckets: int, names: list[str], make):
    @lean
    def run(batches):
        for batch in batches:
            columns = (batch[k].to_pylist() for k in ("docs", "answer0", "answer1"))
            for raw, anchors, repeats in zip(*columns, strict=True):
                docs = unpack_docs(raw)
                texts = text_of(docs)
                w = _Windows(texts, width)
                starts = w.candidates(w.anchors(buckets).answered(anchors))
                gone = w.covered(starts[w.repeats(starts, buckets).answered(repeats)])
                ends = np.cumsum(w.sizes)
                kept = []
                for x, a, b in zip(texts, ends - w.sizes, ends, strict=True):
                    words = (x or b"").split()
                    cut = gone[a:b]
                    kept.append(words if not cut.any() else [t for t, g in zip(words, cut.tolist(), strict=True) if not g])
                n = w.sizes
                yield from pa.table([*docs.columns, *make(n, n - np.array([len(k) for k in kept], np.int64), kept)], names=names).to_batches()

    return run


def _remove(docs: DataFrame, width: int, added: dict[str, str], make) -> DataFrame:
    docs = docs.drop(*added)
    schema = extended(docs, **added)
    with Shards(docs) as shards:
        n = shards.buckets
        anchors = shards.exchange(shards.rows().mapInArrow(_ask_anchors(width, n), "bucket int, shard long, keys binary"), "anchors")
        repeats = shards.exchange(shards.rows(anchors).mapInArrow(_ask_repeats(width, n), "bucket int, shard long, keys binary"), "repeats")
        out = shards.rows(anchors, repeats).mapInArrow(_apply(width, n, schema.names, make), schema)
        return materialize(out.drop("text") if "kept_sha256" in added else out, "substring-out")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the words that stay, a space between)."""

    def make(n, removed, kept):
        return [pa.array(n), pa.array(removed), pa.array([b" ".join(k) for k in kept], pa.binary()).cast(pa.string())]

    return _remove(docs, width, {"n_words": "long", "n_removed": "long", "kept_text": "string"}, make)


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    def make(n, removed, kept):
        return [pa.array(n), pa.array(removed), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept])]

    return _remove(docs.select("doc_id", "text"), width, {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}, make)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
