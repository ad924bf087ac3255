"""Operator 12: hard negatives by bit-sliced integer products.

Components are whole numbers, floor(SCALE * x). A row's components are cut into bit-planes, most significant first; after each plane the inner
product with an anchor lies in an interval whose width halves (what the planes left can add at most and at least follows from the signs of the
anchor's components alone). A pair of anchor and row is dropped as soon as its interval cannot qualify: in the search for positives when its
upper end is below the k-th best lower end seen, in the search for negatives when it misses every margin of the anchor's positives or is
below the k-th best lower end of the rows that surely lie inside. What is left after the last plane has its exact score.

Anchors are a stated set of queries, met with all rows block by block: each pair of blocks is worked off inside a task, a task carries
its k-th best ends from block to block, and only rows that may be among the best leave it. Anchors are broadcast below a checked size, and meet
the blocks by a cartesian product beyond it.

Rows with a null label, a null vector, or any null or non-finite component take no part. An anchor meets rows with as many components as it
has, empty vectors too (score 0), and never a row of its own vec_id; a null vec_id is no anchor, and comes last among ties. Repeated
rows count as often as they stand there, repeated anchors answer once. Components saturate at 2**24 in size, so that scores of up to 2**14
components are exact; longer vectors are an error. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import lean, materialize
from corvane.operators import blocks

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative has LEAST to MOST hundredths of its positive's score.
LEAST, MOST = 80, 100
LIMIT, LONGEST = 1 << 24, 1 << 14
#: Pairs are worked off as a list once fewer than one in SPARSE is left.
SPARSE = 16
#: No score is as low.
NONE = np.int64(-(1 << 62))


def whole(embedding: Column) -> Column:
    """floor(SCALE * x) of each component, null unless all are finite."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = F.transform(embedding, lambda x: F.floor(F.greatest(F.lit(-1.0 * LIMIT), F.least(F.lit(1.0 * LIMIT), F.lit(float(SCALE)) * x.cast("double")))).cast("long"))
    return F.when(good, parts)


class Products:
    """Intervals of the inner products of anchors (q x d) with rows (n x d), plane by plane. ``pairs`` are the places of those still in."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray, live: np.ndarray):
        self.anchors = anchors.astype(np.float64)  # sums of d of them are exact
        self.bits = max(1, int(np.abs(rows).max(initial=0)).bit_length() + 1)
        self.lifted = rows + (1 << (self.bits - 1))  # no bit is below zero
        self.down, self.up = np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1)
        self.i, self.j = np.nonzero(live)
        self.base = -(1 << (self.bits - 1)) * anchors.sum(1)[self.i]

    def planes(self):
        """Yields (i, j, least, most) after each plane; what is answered, a mask, stays in."""
        for k in range(self.bits - 1, -1, -1):
            plane = ((self.lifted >> k) & 1).astype(np.float64)
            if len(self.i) * SPARSE > len(self.anchors) * len(plane):
                columns, place = np.unique(self.j, return_inverse=True)
                part = (self.anchors @ plane[columns].T)[self.i, place]
            else:
                part = np.concatenate([np.einsum("ij,ij->i", self.anchors[self.i[s : s + 65536]], plane[self.j[s : s + 65536]]) for s in range(0, len(self.i), 65536)] or [np.zeros(0)])
            self.base = self.base + (part.astype(np.int64) << k)
            rest = (1 << k) - 1
            keep = yield self.i, self.j, self.base + rest * self.down[self.i], self.base + rest * self.up[self.i]
            self.i, self.j, self.base = self.i[keep], self.j[keep], self.base[keep]

    def run(self, stays):
        steps = self.planes()
        ends = next(steps, None)
        while ends is not None:
            try:
                ends = steps.send(stays(*ends))
            except StopIteration:
                break
        return self.i, self.j, self.base


def kth_best(group: np.ndarray, value: np.ndarray, groups: int, k: int) -> np.ndarray:
    """The k-th largest value of each group, NONE where there are fewer."""
    out = np.full(groups, NONE)
    order = np.lexsort((-value, group))
    g = group[order]
    at = np.arange(len(g)) - np.searchsorted(g, g)
    out[g[at == k - 1]] = value[order][at == k - 1]
    return out


def first(group: np.ndarray, value: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each group: larger values, then smaller ties."""
    order = np.lexsort((tie, -value, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def _sides(row: dict, dim: int):
    """Of a pair of blocks, what has dim components: anchors' places, their vectors, rows' places, their vectors."""
    out = []
    for sizes, flat, lead in ((row["a_sizes"], row["a_items"], 0), (row["sizes"] - 1, row["items"], 1)):
        starts = np.cumsum(sizes + lead) - sizes
        at = np.flatnonzero(sizes == dim)
        out += [at, flat[starts[at][:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim), np.int64)]
    return out


def _blocks(batch: pa.RecordBatch):
    names = batch.schema.names
    for r in range(batch.num_rows):
        row = {name: batch.column(c)[r] for c, name in enumerate(names)}
        asked = row["asked"].values
        vectors = asked.field("ints")
        out = {"ids": row["ids"].values, "sizes": row["sizes"].values.to_numpy().astype(np.int64), "items": row["items"].values.to_numpy()}
        out |= {"block": row["block"].as_py(), "query": asked.field("query_id"), "a_ids": asked.field("vec_id").to_numpy(), "a_labels": asked.field("label").to_numpy()}
        out |= {"a_sizes": vectors.value_lengths().to_numpy().astype(np.int64), "a_items": vectors.flatten().to_numpy()}
        if "margins" in asked.type.names:
            slots = asked.field("margins")
            sizes = slots.value_lengths().to_numpy()
            out["margins"] = np.full((len(asked), int(sizes.max(initial=0))), NONE)
            out["margins"][np.repeat(np.arange(len(asked)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = slots.flatten().to_numpy()
        out["labels"] = out["items"][np.cumsum(out["sizes"]) - out["sizes"]]
        ids = out["ids"]
        out["null"] = ids.is_null().to_numpy(zero_copy_only=False)
        out["values"] = ids.fill_null(0).to_numpy()
        out["tie"] = np.empty(len(ids), np.int64)
        out["tie"][np.lexsort((out["values"], out["null"]))] = np.arange(len(ids))
        yield out


def _search(k: int, negative: bool):
    """Pairs of blocks -> (query_id, slot, other, score): what may be among the k best of an anchor (slot 0), or of one of its margins."""

    @lean
    def run(batches):
        carried: dict[tuple[int, int], np.ndarray] = {}  # block of anchors and length: the k-th best ends so far
        for batch in batches:
            for b in _blocks(batch):
                for dim in np.intersect1d(b["a_sizes"], b["sizes"] - 1).tolist():
                    q, a, n, x = _sides(b, dim)
                    own = (b["a_ids"][q][:, None] == b["values"][n][None, :]) & ~b["null"][n][None, :]
                    same = b["a_labels"][q][:, None] == b["labels"][n][None, :]
                    margins = b["margins"][q] if negative else np.zeros((len(q), 1), np.int64)
                    ends = carried.get((b["block"], dim))
                    ends = np.full(margins.shape, NONE) if ends is None else ends
                    products = Products(a, x, ~own & (~same if negative else same))

                    def fits(i, s, low, high, inside, margins=margins):
                        if not negative:
                            return np.ones(len(i), bool)
                        m = margins[i, s]
                        # surely inside, or perhaps
                        return (m > NONE) & ((LEAST * m <= 100 * low) & (100 * high <= MOST * m) if inside else (LEAST * m <= 100 * high) & (100 * low <= MOST * m))

                    def stays(i, j, low, high, ends=ends):
                        keep = np.zeros(len(i), bool)
                        for s in range(ends.shape[1]):
                            sure = fits(i, s, low, high, True) & (low > ends[i, s])  # others move no end
                            ends[:, s] = np.maximum(ends[:, s], kth_best(i[sure], low[sure], len(ends), k))
                            keep |= fits(i, s, low, high, False) & (high >= ends[i, s])
                        return keep

                    # Ends of one block say how many of its rows are as good; carried over, k rows of earlier blocks are.
                    i, j, score = products.run(stays)
                    carried[b["block"], dim] = ends
                    for s in range(ends.shape[1]):
                        ok = np.flatnonzero(fits(i, s, score, score, True) & (score >= ends[i, s]))
                        ok = ok[first(i[ok], score[ok], b["tie"][n[j[ok]]], k)]
                        yield pa.RecordBatch.from_arrays([b["query"].take(pa.array(q[i[ok]])), pa.array(np.full(len(ok), s), pa.int32()), b["ids"].take(pa.array(n[j[ok]])), pa.array(score[ok])], names=["query_id", "slot", "other", "score"])

    return run


_FOUND = "query_id long, slot int, other long, score long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "slot").orderBy(F.col("score").desc(), F.col("other").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _met(packed: DataFrame, asked: DataFrame, n_blocks: int, few: bool, k: int, negative: bool) -> DataFrame:
    sides = asked.groupBy(blocks.block_of(n_blocks)).agg(F.collect_list(F.struct(*asked.columns)).alias("asked"))
    pairs = packed.crossJoin(F.broadcast(sides) if few else sides)
    return _ranked(pairs.mapInArrow(_search(k, negative), _FOUND), k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows and anchors(vec_id, label, embedding), labels being whole
    numbers."""

    def prepared(df: DataFrame) -> DataFrame:
        ints = whole(F.col("embedding"))
        long = F.when(F.size("ints") > LONGEST, F.raise_error(F.lit(f"a vector of over {LONGEST} components"))).otherwise(F.col("ints"))
        return df.select("vec_id", F.col("label").cast("long").alias("label"), ints.alias("ints")).filter("label IS NOT NULL AND ints IS NOT NULL").withColumn("ints", long)

    packed = materialize(blocks.pack_rows(prepared(rows).select("vec_id", F.concat(F.array("label"), "ints").alias("items"))), "negatives-rows")
    asked = prepared(anchors).filter("vec_id IS NOT NULL").distinct()
    asked = materialize(asked.select(F.monotonically_increasing_id().alias("query_id"), "*"), "negatives-anchors")
    n_blocks, few = blocks.question_blocks(asked.select("query_id", F.size("ints").alias("n")))
    best = materialize(_met(packed, asked, n_blocks, few, positives, False), "negatives-positives")
    # Margins of an anchor in the order of its positives; those of equal scores are alike.
    margins = best.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("margins"))
    found = _met(packed, asked.join(margins, "query_id"), n_blocks, few, negatives, True)
    out = found.select("query_id", (F.col("slot") + 1).alias("place"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(best.select("query_id", F.col("rank").alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), ["query_id", "place"])
    out = out.join(asked.select("query_id", F.col("vec_id").alias("anchor_id")), "query_id")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Every hundredth row of the embeddings against all of them; labels of every seventh are moved on by one."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = v.select("vec_id", label.alias("label"), "embedding")
    return mine(v, v.filter(F.col("vec_id") % 100 == 0))
