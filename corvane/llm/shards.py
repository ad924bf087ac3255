"""Documents in bounded shards that stay where they are, while packed sets of hashes travel.

``Shards`` holds documents as rows (shard, docs): a shard is up to SHARD_BYTES of text in one compressed Arrow block, in a
table bucketed by shard. ``exchange`` asks, for every key that a shard has, whether the key occurs anywhere else: shards send each
key once (with whether they have it twice, and a mark), reducers answer with one bit for each key sent. A
key in a third of all documents is therefore one entry for each shard that has it, and answers return by
joining on shard, which moves the packed bits alone: the table's side of that join needs no shuffle.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import lean, materialize, partitions
from corvane.llm.wordhash import planes, unplanes

#: Text of a shard, with 64 bytes for every document, so that empty ones fill shards too.
SHARD_BYTES = 4 << 20
#: Bits of a key beside those of its bucket in a first, coarse exchange; what it passes is always checked again.
COARSE_BITS = 30


def pack_docs(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_docs(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def text_of(table: pa.Table) -> list[bytes | None]:
    column = table["text"]
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


class Shards:
    """Use as a context manager: the table goes at the end, so results must be materialised inside."""

    def __init__(self, docs: DataFrame, shard_bytes: int = SHARD_BYTES, note=None):
        """note(texts) -> bytes is kept beside each shard, for what every pass would have to compute again."""
        self.spark, self.docs, self.note = docs.sparkSession, docs, note
        self.buckets = 1 << (2 * partitions(self.spark) - 1).bit_length()
        self.name, self.shard_bytes = f"corvane_shards_{uuid.uuid4().hex}", shard_bytes

    def __enter__(self) -> Shards:
        most, note = self.shard_bytes, self.note

        @lean
        def run(batches):
            part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

            def flush():
                nonlocal count, held, size
                table = pa.Table.from_batches(held)
                noted = note(text_of(table)) if note else None
                row = pa.RecordBatch.from_arrays([pa.array([(part << 24) + count], pa.int64()), pa.array([pack_docs(table)], pa.binary()), pa.array([noted], pa.binary())], names=["shard", "docs", "note"])
                count, held, size = count + 1, [], 0
                return row

            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                sizes = np.array([64 + len(x or b"") for x in texts.cast(pa.binary() if not pa.types.is_large_string(texts.type) else pa.large_binary()).to_pylist()], np.int64)
                at = 0
                while at < batch.num_rows:
                    room = np.searchsorted(np.cumsum(sizes[at:]), max(1, most - size)) + 1
                    held.append(batch.slice(at, int(room)))
                    size += int(sizes[at : at + room].sum())
                    at += int(room)
                    if size >= most:
                        yield flush()
            if held:
                yield flush()

        rows = self.docs.mapInArrow(run, "shard long, docs binary, note binary")
        rows.write.bucketBy(self.buckets, "shard").option("compression", "uncompressed").saveAsTable(self.name)
        return self

    def __exit__(self, *_):
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self, *answers: DataFrame) -> DataFrame:
        """(shard, docs, note, answer0, answer1, ...)."""
        out = self.spark.table(self.name)
        for k, a in enumerate(answers):
            packed = a.groupBy(F.col("shard").alias(f"shard{k}")).agg(F.collect_list(F.struct("bucket", "bits")).alias(f"answer{k}"))
            out = out.join(packed, F.col("shard") == F.col(f"shard{k}"), "left").drop(f"shard{k}")
        return out

    def beside(self, rows: DataFrame, name: str) -> DataFrame:
        """(shard, docs, note, name): the rows of each shard, but for their shard, as an array; a shard's texts bound it."""
        packed = rows.groupBy(F.col("shard").alias("beside")).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "shard"])).alias(name))
        return self.spark.table(self.name).join(packed, F.col("shard") == F.col("beside"), "left").drop("beside")

    def exchange(self, asked: DataFrame, name: str) -> DataFrame:
        """(bucket, shard, keys) -> (shard, bucket, bits): see Keys for what keys holds."""
        return materialize(asked.groupBy("bucket").applyInArrow(_answer, "shard long, bucket int, bits binary"), name)


class Keys:
    """The keys that a shard asks about, sorted, each once; ``hi`` decides the bucket, ``lo`` makes keys 96 bits wide."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray | None, marked: np.ndarray, buckets: int):
        self.shift = 64 - (buckets - 1).bit_length()
        self.coarse = lo is None
        if self.coarse:
            hi = hi >> np.uint64(self.shift - COARSE_BITS)
            order = np.argsort(hi)
            ranked = hi[order]
            new = np.ones(len(hi), bool)
            new[1:] = ranked[1:] != ranked[:-1]
        else:
            order = np.lexsort((lo, hi))
            ranked, low = hi[order], lo[order]
            new = np.ones(len(hi), bool)
            new[1:] = (ranked[1:] != ranked[:-1]) | (low[1:] != low[:-1])
        self.at = np.empty(len(hi), np.int64)  # of each asked key in the sorted ones
        self.at[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.hi, self.lo = ranked[first], None if self.coarse else low[first]
        count = np.diff(np.append(first, len(hi)))
        mark = np.logical_or.reduceat(marked[order], first) if len(first) else np.zeros(0, bool)
        self.flags = mark.astype(np.uint32) | ((count > 1).astype(np.uint32) << np.uint32(1))
        self.bucket = (self.hi >> np.uint64(COARSE_BITS if self.coarse else self.shift)).astype(np.int64)
        self.rims = np.searchsorted(self.bucket, np.arange(buckets + 1))

    def rows(self, shard: int, buckets: int):
        used = np.flatnonzero(np.diff(self.rims))
        packed = []
        for b in used:
            part = slice(self.rims[b], self.rims[b + 1])
            if self.coarse:
                key = (self.hi[part] & np.uint64((1 << COARSE_BITS) - 1)).astype(np.uint32)
                packed.append(b"c" + planes((np.diff(key, prepend=np.uint32(0)) << np.uint32(2)) | self.flags[part]))
            else:
                packed.append(b"f" + np.packbits(self.flags[part].astype(np.uint8).reshape(-1, 1) & np.array([1, 2], np.uint8) > 0).tobytes() + planes(self.hi[part]) + planes(self.lo[part]))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([shard] * len(used), pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "shard", "keys"])

    def answered(self, answer: list[dict] | None) -> np.ndarray:
        """For each asked key whether the answer is yes."""
        yes = np.zeros(len(self.hi), bool)
        for x in answer or ():
            a, b = self.rims[x["bucket"]], self.rims[x["bucket"] + 1]
            yes[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a)
        return yes[self.at]


def _read(raw: bytes):
    if raw[:1] == b"c":
        v = unplanes(raw[1:], np.uint32)
        return np.cumsum(v >> np.uint32(2), dtype=np.uint64), np.zeros(len(v), np.uint32), v & np.uint32(3)
    # 12 bytes and 2 bits for each key
    n = next(n for n in [(len(raw) - 1) * 4 // 49, (len(raw) - 1) * 4 // 49 + 1] if 1 + -(-2 * n // 8) + 12 * n == len(raw))
    f = -(-2 * n // 8)
    two = np.unpackbits(np.frombuffer(raw, np.uint8, f, 1), count=2 * n).reshape(n, 2).astype(np.uint32)
    return unplanes(raw[1 + f : 1 + f + 8 * n], np.uint64), unplanes(raw[1 + f + 8 * n :], np.uint32), two[:, 0] | two[:, 1] << np.uint32(1)


def _answer(table: pa.Table) -> pa.Table:
    """Yes for keys that two shards have, or one twice, if any occurrence is marked."""
    shards, bucket = table["shard"].to_pylist(), table["bucket"][0].as_py()
    read = [_read(x) for x in table["keys"].to_pylist()]
    hi, lo, flags = (np.concatenate(x) for x in zip(*read, strict=True))
    order = np.lexsort((lo, hi)) if lo.any() else np.argsort(hi)
    ranked, low = hi[order], lo[order]
    new = np.ones(len(hi), bool)
    new[1:] = (ranked[1:] != ranked[:-1]) | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    count = np.add.reduceat(1 + (flags[order] >> np.uint32(1)).astype(np.int64), first)
    mark = np.bitwise_or.reduceat(flags[order] & np.uint32(1), first) > 0
    yes = np.empty(len(hi), bool)
    yes[order] = np.repeat((count > 1) & mark, np.diff(np.append(first, len(hi))))
    ends = np.cumsum([len(x[0]) for x in read])
    bits = [np.packbits(x).tobytes() for x in np.split(yes, ends[:-1])]
    return pa.table({"shard": pa.array(shards, pa.int64()), "bucket": pa.array([bucket] * len(shards), pa.int32()), "bits": pa.array(bits, pa.binary())})
