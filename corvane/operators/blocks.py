"""Blocks of rows against blocks of questions: a task scores one pair of blocks at a time, and only its best k rows of each question leave it.

Both sides are packed first, so that a join of blocks copies some MB for each pair and no row for a pair of row and question. The number
of question blocks follows from the questions and their items, so the memory of a task doesn't grow with the tables; what a question and a
row have in common is added up in numpy and never becomes rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and items of a block of rows; a block ends with the row that fills it.
ROWS, ITEMS = 4096, 1 << 20
PIECE = 256
#: Questions and items of a block of questions, about.
QUESTIONS, ASKED = 512, 1 << 17
#: Pairs of row and question that are added up at once.
PAIRS = 1 << 19
#: So many items of questions at most are broadcast, of less than 64 bytes each, by way of the driver.
FEW = 1 << 20


def pack_rows(rows: DataFrame) -> DataFrame:
    """(id, list) -> (ids, sizes, items), a row for each block. Null and empty lists have no place in it."""
    id_type, item_type = rows.schema[0].dataType.simpleString(), rows.schema[1].dataType.elementType.simpleString()
    return rows.mapInArrow(_packed, f"ids array<{id_type}>, sizes array<int>, items array<{item_type}>")


def _pieces(batches):
    """Rows that have items, in copies of a few rows at a time: a block that is not full keeps them alone in memory, not the batch they came in."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            piece = batch.slice(at, PIECE)
            yield piece.filter(pc.fill_null(pc.greater(pc.list_value_length(piece.column(1)), 0), False))
        batch = piece = None


def _packed(batches):
    held, count, size = [], 0, 0
    for batch in _pieces(batches):
        lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            room = min(int(np.searchsorted(np.cumsum(lengths[at:]), ITEMS - size)) + 1, ROWS - count, batch.num_rows - at)
            held.append(batch.slice(at, room))
            count, size, at = count + room, size + int(lengths[at : at + room].sum()), at + room
            if count >= ROWS or size >= ITEMS:
                yield _block(held)
                held, count, size = [], 0, 0
    if held:
        yield _block(held)


def _block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    ids = pa.concat_arrays([b.column(0) for b in held])
    sizes = pa.concat_arrays([pc.list_value_length(b.column(1)).cast(pa.int32()) for b in held])
    items = pa.concat_arrays([b.column(1).flatten() for b in held])
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, sizes, items)], names=["ids", "sizes", "items"])


def question_blocks(sizes: DataFrame) -> tuple[int, bool]:
    """Of (query_id, n), the items of each question: how many blocks they fill, and whether all of them may be broadcast."""
    asked, items = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return max(1, -(-asked // QUESTIONS), -(-items // ASKED)), items <= FEW and asked <= FEW


def block_of(n_blocks: int):
    return F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block")


def carried(asked: DataFrame) -> Broadcast:
    """A few rows of questions, for tasks to read with ``unpacked``: each worker has them once, where a broadcast join would copy them beside every row
    and hand a partition's copies to Python in one batch."""
    sink = pa.BufferOutputStream()
    table = asked.toArrow()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return asked.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def unpacked(carrier: Broadcast) -> list[dict]:
    """The rows of ``carried``, values as Arrow scalars."""
    table = pa.ipc.open_stream(carrier.value).read_all()
    return [{name: table.column(name)[i] for name in table.column_names} for i in range(table.num_rows)]


def meet(rows: DataFrame, asked: DataFrame, few: bool, kernel, k: int, id_type: str, query_type: str) -> DataFrame:
    """Of rows(id, list): kernel(ids, sizes, items, row) -> query ids, scores (a line for each question, a column for each id), which of them count.
    Gives (query_id, doc_id, score): of each block the best k of each question after rounding, ties to the smaller id."""
    schema = f"query_id {query_type}, doc_id {id_type}, score double"

    def scored(block, i, row):
        ids = block.column(0)[i].values
        queries, scores, valid = kernel(ids, block.column(1)[i].values.to_numpy(), block.column(2)[i].values, row)
        line, column = best(scores, valid, ids, k)
        return pa.RecordBatch.from_arrays([queries.take(pa.array(line)), ids.take(pa.array(column)), pa.array(scores[line, column])], names=["query_id", "doc_id", "score"])

    if few:
        carrier = carried(asked)

        def run(batches):
            sides = unpacked(carrier)
            for block in _packed(batches):
                for row in sides:
                    yield scored(block, 0, row)

        return rows.mapInArrow(run, schema)

    def pairs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield scored(batch, i, {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)})

    return pack_rows(rows).crossJoin(asked).mapInArrow(pairs, schema)


def best(scores: np.ndarray, valid: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the best k of each line."""
    place = np.empty(len(ids), np.int64)
    place[pc.array_sort_indices(ids, order="ascending").to_numpy()] = np.arange(len(ids))
    shown = np.where(valid, np.round(scores, 6), -np.inf)
    lines, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, v in enumerate(shown):
        least = np.partition(v, len(v) - k)[len(v) - k] if len(v) > k else -np.inf
        some = np.flatnonzero((v >= least) & (v > -np.inf))
        some = some[np.lexsort((place[some], -v[some]))[:k]]
        lines.append(np.full(len(some), i))
        columns.append(some)
    return np.concatenate(lines), np.concatenate(columns)


def bm25_kernel(k1: float, b: float):
    """Items are hashed terms; a row of questions has asked, structs of query_id, term and idf, and avg_dl."""

    def run(ids, sizes, items, row):
        asked, average = row["asked"].values, row["avg_dl"].as_py()
        queries = asked.field("query_id").dictionary_encode()
        line, term, idf = queries.indices.to_numpy().astype(np.int64), asked.field("term").to_numpy(), asked.field("idf").to_numpy()
        order = np.lexsort((line, term))
        line, idf = line[order], idf[order]
        words, first, asking = np.unique(term[order], return_index=True, return_counts=True)
        terms = items.to_numpy()
        at = np.minimum(np.searchsorted(words, terms), len(words) - 1)
        hit = words[at] == terms
        doc = np.repeat(np.arange(len(ids)), sizes)[hit]
        posting, tf = np.unique(doc * len(words) + at[hit], return_counts=True)
        doc, at = np.divmod(posting, len(words))
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / average))
        n = asking[at]
        asked_by = len(queries.dictionary)
        total = np.zeros(len(ids) * asked_by)
        ends = np.cumsum(n)
        start = 0
        while start < len(n):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
            m = n[start:stop]
            # The m[j] questions of posting j are the entries from first[at[j]] on; postings are in the order of their rows.
            entry = np.repeat(first[at[start:stop]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            low, high = int(doc[start]) * asked_by, (int(doc[stop - 1]) + 1) * asked_by
            total[low:high] += np.bincount(line[entry] + np.repeat(doc[start:stop] * asked_by - low, m), np.repeat(part[start:stop], m) * idf[entry], high - low)
            start = stop
        scores = total.reshape(len(ids), asked_by).T
        return queries.dictionary, scores, scores > 0

    return run


def cosine_kernel(ids, sizes, items, row):
    """Items are components; a row of questions has asked, structs of query_id and embedding. A row isn't an answer to the question of its own id."""
    asked = row["asked"].values
    queries, vectors = asked.field("query_id"), asked.field("embedding")
    lengths, flat = pc.list_value_length(vectors).to_numpy(zero_copy_only=False), _double(vectors.flatten())
    items, starts, begins = _double(items), np.cumsum(sizes) - sizes, np.cumsum(lengths) - lengths
    scores = np.full((len(queries), len(ids)), np.nan)
    for dim in np.intersect1d(sizes, lengths).astype(int):
        r, q = np.flatnonzero(sizes == dim), np.flatnonzero(lengths == dim)
        x, y = (_unit(v[at[:, None] + np.arange(dim)]) for v, at in ((items, starts[r]), (flat, begins[q])))
        scores[np.ix_(q, r)] = y @ x.T
    known = pc.unique(queries)
    own = pc.index_in(ids.cast(queries.type), value_set=known).fill_null(-1).to_numpy()
    return queries, scores, ~np.isnan(scores) & (pc.index_in(queries, value_set=known).to_numpy()[:, None] != own[None, :])


def _double(x: pa.Array) -> np.ndarray:
    return x.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null as NaN


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of NaN where they are zero or not finite."""
    with np.errstate(all="ignore"):
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return np.where(np.isfinite(norm) & (norm > 0), v / norm, np.nan)
