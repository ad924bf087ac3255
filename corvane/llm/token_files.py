"""Operator 3: token ids in binary files, coded by a static range asymmetric numeral system (rANS).

A folder holds everything that its reader needs: ``table`` (id, freq), the one frequency table of all blocks, counted over all
documents, and ``blocks``, written last. Both are Parquet datasets whose rows are whole or absent, by Spark's committer; a lost
executor's blocks are written again. A block is a self-contained row and holds up to BLOCK_TOKENS ids in LANES interleaved
streams: lane k codes ids k, k + LANES, ... Checkpoints keep the lanes' states and the place in the words every CHECK_ROWS rows;
the reader decodes a block from all its checkpoints at once, lane beside lane. Checksums cover the table, the coded words and the ids.

Documents stand in ascending doc_id order (null last, ties by content) over range partitions named shards; a document
longer than a block goes on in the next one. Null text is the empty text, which has its end id alone; repeated rows are as many
documents; other columns are not read, whatever their names. An empty table gives an empty dataset.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.bpe import as_bytes, encoder, slices, tokenizer_path
from corvane.llm.common import documents, lean, materialize, partitions, work_dir

MAGIC, VERSION = b"CVRA", 2
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 2048
BLOCK_TOKENS = 1 << 19
CHECK_ROWS = 128
END_ID = 1
SIZES = struct.Struct("<4sHHIIII")  # magic, version, scale bits, ids, lanes, checkpoints, words
HEAD = struct.Struct("<4sHHIIIIII")  # these, crc of them, of checkpoints and words, crc of ids


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts -> frequencies that sum to 2**bits, at least 1 for every id that occurs."""
    total, room = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    if int((counts > 0).sum()) > room:
        raise ValueError("more distinct ids than frequency slots")
    freq = np.where(counts > 0, np.maximum(1, counts.astype(object) * room // total).astype(np.int64), 0)
    left = room - int(freq.sum())
    order = np.lexsort((np.arange(len(freq)), -freq))
    while left:  # what rounding left, from or to the most frequent
        for i in order:
            step = left if left > 0 else -min(-left, int(freq[i]) - 1, max(1, int(freq[i]) // 8))
            if freq[i] and step:
                freq[i] += step
                left -= step
            if not left:
                break
    return freq


class Tables:
    """Shared by all blocks; a few MB, set by the vocabulary and SCALE_BITS."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_block(ids: np.ndarray, tables: Tables, lanes: int = LANES, check_rows: int = CHECK_ROWS) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 32))
    rows = -(-n // lanes)
    bits, state = np.uint64(tables.bits), np.full(lanes, LOW, np.uint64)
    limit_shift = np.uint64(31 - tables.bits + 32)
    freq, start = tables.freq[ids], tables.start[ids]
    words, marks = [b""] * rows, []
    for r in range(rows - 1, -1, -1):
        f, c = freq[r * lanes : (r + 1) * lanes], start[r * lanes : (r + 1) * lanes]
        x = state[: len(f)]
        over = x >= (f << limit_shift)
        words[r] = (x[over] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << bits) + (x - q * f) + c
        if r % check_rows == 0:
            marks.append((r, state.copy()))
    marks.reverse()
    sizes = np.concatenate([[0], np.cumsum([len(w) // 4 for w in words])]).astype(np.int64) if rows else np.zeros(1, np.int64)
    body = b"".join(words)
    sizes_ = (MAGIC, VERSION, tables.bits, n, lanes, len(marks), len(body) // 4)
    held = b"".join([*(struct.pack("<II", r, int(sizes[r])) + s.astype("<u8").tobytes() for r, s in marks), body])
    return HEAD.pack(*sizes_, zlib.crc32(held, zlib.crc32(SIZES.pack(*sizes_))), zlib.crc32(ids.astype("<u4").tobytes())) + held


def decode_block(raw: bytes, tables: Tables, first: int = 0, last: int | None = None) -> np.ndarray:
    """All ids of a block, or those from checkpoint ``first`` to before checkpoint ``last``; raises on a broken checksum.

    All spans between checkpoints are decoded side by side: one step takes a row of each."""
    magic, version, bits, n, lanes, marks, n_words, crc_held, crc_ids = HEAD.unpack_from(raw)
    if magic != MAGIC or version != VERSION or bits != tables.bits:
        raise ValueError("not a block of this format")
    if zlib.crc32(raw[HEAD.size :], zlib.crc32(raw[: SIZES.size])) != crc_held:
        raise ValueError("the words of a block are damaged")
    at, row, place, states = HEAD.size, [], [], []
    for _ in range(marks):
        r, w = struct.unpack_from("<II", raw, at)
        row.append(r)
        place.append(w)
        states.append(np.frombuffer(raw, "<u8", lanes, at + 8))
        at += 8 + 8 * lanes
    if not n:
        return np.zeros(0, np.uint32)
    words = np.append(np.frombuffer(raw, "<u4", n_words, at), np.zeros(1, "<u4")).astype(np.uint64)
    last = marks if last is None else min(last, marks)
    starts = np.array(row[first:last], np.int64)
    place = np.array(place[first:last], np.int64)
    state = np.stack(states[first:last])
    ends = np.append(starts[1:], row[last] if last < marks else -(-n // lanes))
    steps = ends - starts
    out = np.zeros(int(steps.sum()) * lanes, np.uint32)
    rows = out.reshape(-1, lanes)
    offset = starts - starts[0]
    scale, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    tail = n - (n - 1) // lanes * lanes  # ids in the block's last row
    for r in range(int(steps.max())):
        on = np.flatnonzero(steps > r)
        x = state if len(on) == len(steps) else state[on]
        slot = x & mask
        s = tables.symbol[slot]
        x = tables.freq[s] * (x >> scale) + slot - tables.start[s]
        low = x < LOW
        if last == marks and on[-1] == len(steps) - 1 and r == steps[-1] - 1:
            low[-1, tail:] = False  # lanes without an id in this row
        taken = np.cumsum(low, axis=1)
        span, lane = np.nonzero(low)
        x[span, lane] = (x[span, lane] << np.uint64(32)) | words[place[on][span] + taken[span, lane] - 1]
        place[on] += taken[:, -1]
        state[on] = x
        rows[offset[on] + r] = s
    out = out[: n - int(starts[0]) * lanes] if last == marks else out
    if first == 0 and last == marks and zlib.crc32(out.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("the ids of a block are damaged")
    return out


def crc_join(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings after each other from theirs and the second's length: first * x^(8 length) + second."""

    def times(a: int, b: int) -> int:  # in GF(2)[x] modulo the polynomial; the top bit is x^0
        out = 0
        for k in range(31, -1, -1):
            if a >> k & 1:
                out ^= b
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, square, e = 1 << 31, 1 << 23, length  # x^0, x^8
    while e:
        if e & 1:
            power = times(power, square)
        square = times(square, square)
        e >>= 1
    return times(power, first) ^ second


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, tie, packed) for each document, and for each task a row with counts (id, occurrences) instead: one pass over
    the texts gives both."""
    coder = encoder(path)
    size, width = coder.size, np.dtype(coder.type).str

    @lean
    def run(batches):
        coder, total = encoder(path), np.zeros(size, np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in slices(texts):
                ids = coder.encode_batch(texts[a:b])
                total += np.bincount(np.concatenate(ids), minlength=size)
                total[END_ID] += b - a
                packed = [x.tobytes() for x in ids]
                tie = pa.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in packed])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), tie, pa.array(packed, pa.binary()), pa.nulls(b - a, pa.binary())], names=["doc_id", "tie", "packed", "counts"])
        coder.forget()
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.stack([used, total[used]]).tobytes()], pa.binary())], names=["doc_id", "tie", "packed", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tie long, packed binary, counts binary")


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each id over all documents; the driver gets a row per id of the vocabulary at most."""

    @lean
    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids, n = np.frombuffer(raw, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    rows = tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


_BLOCK = "shard int, block int, first long, n_tokens long, seq array<long>, doc_id array<long>, doc_first array<long>, part array<int>, n array<long>, payload binary"
_TABLE = "bits int, size int, ids binary, freqs binary, crc32 long"


def write_files(docs: DataFrame, folder: str | None = None, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> str:
    """Tokenises, counts, codes and writes; returns the folder, by default a new one in the session's shared folder."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "token-files")
    coder = encoder(path)
    size, width = coder.size, np.dtype(coder.type).str
    tokens = materialize(tokenise(docs, path), "ids")
    freq = scaled(count_ids(tokens, size))
    ids, freqs = np.flatnonzero(freq), freq[freq > 0]
    rows = [(SCALE_BITS, size, ids.astype("<u4").tobytes(), freqs.astype("<u4").tobytes(), zlib.crc32(ids.astype("<u4").tobytes() + freqs.astype("<u4").tobytes()))]
    spark.createDataFrame(rows, _TABLE).coalesce(1).write.parquet(f"{folder}/table")
    tables = spark.sparkContext.broadcast(freq)

    @lean
    def run(batches):
        table, shard = Tables(tables.value), TaskContext.get().partitionId()
        end = np.array([END_ID], width).tobytes()
        held, entries, block, first, have, seq, done = [], [], 0, 0, 0, 0, 0
        item = np.dtype(width).itemsize

        def flush():
            nonlocal held, entries, block, first, have
            ids = np.frombuffer(b"".join(held), width)
            cols = list(zip(*entries, strict=True))
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([have]), *(pa.array([list(c)], pa.list_(t)) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)), pa.array([encode_block(ids.astype(np.int64), table)], pa.binary())],
                names=["shard", "block", "first", "n_tokens", "seq", "doc_id", "doc_first", "part", "n", "payload"],
            )
            first, block, held, entries, have = first + have, block + 1, [], [], 0
            return out

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, part, at = raw + end, 0, 0
                while at < len(raw):
                    take = raw[at : at + (block_tokens - have) * item]
                    held.append(take)
                    entries.append((seq, doc_id, done, part, len(take) // item))
                    have, part, at = have + len(take) // item, part + 1, at + len(take)
                    if have >= block_tokens:
                        yield flush()
                seq, done = seq + 1, done + len(raw) // item
        if have:
            yield flush()

    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    ranged = tokens.filter("counts IS NULL").select("doc_id", "tie", "packed").repartitionByRange(max(2, partitions(spark)), *order).sortWithinPartitions(*order, F.col("packed"))
    ranged.select("doc_id", "packed").mapInArrow(run, _BLOCK).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    return folder


def read_table(spark: SparkSession, folder: str) -> Tables:
    """The frequency table of a folder: one row, a few hundred KB by the vocabulary."""
    row = spark.read.schema(_TABLE).parquet(f"{folder}/table").first()
    if zlib.crc32(bytes(row["ids"]) + bytes(row["freqs"])) != row["crc32"]:
        raise ValueError("the frequency table is damaged")
    freq = np.zeros(row["size"], np.int64)
    freq[np.frombuffer(row["ids"], "<u4")] = np.frombuffer(row["freqs"], "<u4")
    return Tables(freq, row["bits"])


@lean
def _join_crcs(batches):
    for batch in batches:
        crcs = []
        for items in batch.column(0).to_pylist():
            crc = items[0]["crc"]
            for x in items[1:]:
                crc = crc_join(crc, x["crc"], 4 * x["n"])
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(crcs, pa.int64())], names=[*batch.schema.names[1:], "ids_crc32"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a folder's files, from the decoded ids; the folder is all it takes."""
    tables = read_table(spark, folder)
    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")
    shared = spark.sparkContext.broadcast((tables.freq.astype(np.int64), tables.bits))

    @lean
    def run(batches):
        table = Tables(*shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                ids, at, crcs = decode_block(r["payload"], table), 0, []
                for n in r["n"]:
                    crcs.append(zlib.crc32(ids[at : at + n].astype("<u4").tobytes()))
                    at += n
                m = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * m, pa.int32()), pa.array(r["seq"], pa.int64()), pa.array(r["doc_id"], pa.int64()), pa.array(r["doc_first"], pa.int64()), pa.array(r["part"], pa.int32()), pa.array(r["n"], pa.int64()), pa.array(crcs, pa.int64())],
                    names=["shard", "seq", "doc_id", "doc_first", "part", "n", "crc"],
                )

    parts = blocks.mapInArrow(run, "shard int, seq long, doc_id long, doc_first long, part int, n long, crc long")
    grouped = parts.groupBy("shard", "seq", "doc_id", "doc_first").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "n", "crc"))).alias("parts"))
    # Only documents that go over a block's end have several parts, two for most blocks.
    grouped = materialize(grouped, "block-documents")
    names = ["shard", "doc_id", "doc_first", "n_tokens"]
    one = grouped.filter(F.size("parts") == 1).select(*names, F.col("parts")[0]["crc"].alias("ids_crc32"))
    more = grouped.filter(F.size("parts") > 1).select("parts", *names).mapInArrow(_join_crcs, "shard int, doc_id long, doc_first long, n_tokens long, ids_crc32 long")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    bases = materialize(shards.select("shard", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base")), "shard-bases")
    out = one.unionByName(more).join(bases, "shard")
    return out.select("doc_id", (F.col("base") + F.col("doc_first")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    return read_documents(spark, write_files(documents(spark, sf_dir)))
