"""Operator 6: near-duplicate vectors through a pivot-permutation index.

Pivots are reference points: farthest-first picks among the SAMPLE classes with the smallest hashes (all rows are indexed; only
the pivots come from a bounded sample). A vector is described by its NEAREST pivots, in order. Inverted lists are keyed
by pairs of pivots and hold numbers of pivots and a sketch, no vectors; a pair of vectors meets in the list of the two smallest pivots that they share,
once, and only if they share SHARED pivots at least. The sketch is a projection on SKETCH axes of the sample, a byte each: projections are never
farther apart than the vectors, so what it rules out can't be linked. Vectors are fetched for the lists where a partner is left, and the
cosine in double precision decides. Tasks return counts and a spanning forest for each list, never pairs; lists over BLOCK vectors are cut into
pairs of blocks. The number of pivots grows with the square root of the number of vectors, so that lists keep their length, up to
MOST_PIVOTS; beyond it lists grow and are cut into more blocks, no pair is left out.

Equal vectors are one class with a weight, told apart by 128 bits of hash and numbered. Null vectors, zero vectors and those with null or non-finite
components link with nothing and are their own component; vectors meet those of their own length alone, in an index for each. A
null vec_id never is the smallest. Rows may repeat a vec_id; other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import lean, materialize, partitions
from corvane.llm.components import components

THRESHOLD = 0.95
SAMPLE = 4096
NEAREST, SHARED = 8, 3
SKETCH = 16
LEAST_PIVOTS, MOST_PIVOTS = 48, 4096
BLOCK = 1024


def matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision of an Arrow list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    picked = [0]
    nearest = x @ x[0]
    while len(picked) < min(k, len(x)):
        i = int(np.argmin(nearest))
        if nearest[i] > 1 - 1e-9:
            break
        picked.append(i)
        nearest = np.maximum(nearest, x @ x[i])
    return x[picked]


def axes(x: np.ndarray, k: int = SKETCH) -> np.ndarray:
    """Orthonormal columns along which the sample spreads most."""
    spread = x - x.mean(0)
    return np.linalg.eigh(spread.T @ spread)[1][:, ::-1][:, :k]


def within_reach(threshold: float) -> float:
    """The largest squared distance of the sketches, in units of a byte, of two unit vectors whose cosine reaches the threshold: half a unit
    is lost to rounding on each axis of either."""
    return (127 * math.sqrt(max(0.0, 2 - 2 * threshold)) + math.sqrt(SKETCH) + 1e-3) ** 2


def partners(sets: np.ndarray, left: np.ndarray, right: np.ndarray, key: tuple[int, int], shared: int, sketches: np.ndarray | None = None, reach: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in left, in right) whose two smallest shared pivots are the key's, with ``shared`` in common and sketches within reach;
    each pair once."""
    pivots = np.unique(sets)
    place = np.searchsorted(pivots, sets)
    has = np.zeros((len(sets), len(pivots)), np.float32)
    np.put_along_axis(has, place, 1, 1)
    before = has[:, (pivots < key[1]) & (pivots != key[0])]
    ok = (has[left] @ has[right].T >= shared) & (before[left] @ before[right].T == 0)
    if sketches is not None:  # whole numbers below 2**24: exact in single precision
        a, b = sketches[left].astype(np.float32), sketches[right].astype(np.float32)
        ok &= (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T) <= reach
    i, j = np.nonzero(ok)
    if np.array_equal(left, right):
        i, j = i[i < j], j[i < j]
    return i, j


def links_within(x: np.ndarray, sets: np.ndarray, left: np.ndarray, right: np.ndarray, key: tuple[int, int], shared: int, threshold: float, sketches: np.ndarray | None = None):
    """Linked pairs (i, j) of left x right among those partners."""
    i, j = partners(sets, left, right, key, shared, sketches, within_reach(threshold))
    if not len(i):
        return i, j
    if len(i) * 4 > len(left) * len(right):
        near = (x[left] @ x[right].T)[i, j] >= threshold
    else:
        near = np.concatenate([np.einsum("ij,ij->i", x[left[i[a : a + 65536]]], x[right[j[a : a + 65536]]]) for a in range(0, len(i), 65536)]) >= threshold
    return left[i[near]], right[j[near]]


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(v):
        while parent.get(v, v) != v:
            parent[v] = parent.get(parent[v], parent[v])
            v = parent[v]
        return v

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


_LISTED = "p int, q int, cls long, pivots binary"
_KEYED = "p int, q int, i int, j int, block int, cls long, pivots binary"


def _post(index, nearest: int):
    """(cls, embedding) -> a row for every pair of its nearest pivots that leaves a larger one: its pivots, two bytes each, and its sketch."""

    @lean
    def run(batches):
        p, basis = index.value
        for batch in batches:
            x = matrix(batch.column(1))
            m = min(nearest, len(p))
            similar = x @ p.T
            sets = np.sort(np.argpartition(-similar, m - 1, axis=1)[:, :m], axis=1).astype("<u2") if m < len(p) else np.tile(np.arange(len(p), dtype="<u2"), (len(x), 1))
            a, b = (np.zeros(1, np.int64), np.zeros(1, np.int64)) if m < SHARED else np.triu_indices(m - SHARED + 2, 1)
            row = np.repeat(np.arange(len(x)), len(a))
            sketch = np.zeros((len(x), SKETCH), np.int8)
            sketch[:, : basis.shape[1]] = np.rint(127 * (x @ basis))
            held = np.concatenate([sets.view(np.uint8).reshape(len(x), -1), sketch.view(np.uint8)], 1)
            width = held.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.arange(0, width * len(row) + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(held[row]))])
            yield pa.RecordBatch.from_arrays([pa.array(sets[:, a].ravel().astype(np.int32)), pa.array(sets[:, b].ravel().astype(np.int32)), batch.column(0).take(pa.array(row)), packed], names=["p", "q", "cls", "pivots"])

    return run


def _lists(table: pa.Table):
    """(key, rows, places of its first block, of its second one, pivots of the rows, sketches) of each list of a bucket."""
    keys = np.stack([table[k].to_numpy() for k in ("p", "q", "i", "j")], 1)
    held = np.frombuffer(b"".join(table["pivots"].to_pylist()), np.uint8).reshape(len(keys), -1)
    sets, sketches = np.ascontiguousarray(held[:, :-SKETCH]).view("<u2"), np.ascontiguousarray(held[:, -SKETCH:]).view(np.int8)
    block = table["block"].to_numpy()
    order = np.lexsort(keys.T[::-1])
    edges = np.flatnonzero((keys[order][1:] != keys[order][:-1]).any(1)) + 1
    for rows in np.split(order, edges):
        if len(rows) > 1:
            p, q, i, j = keys[rows[0]]
            yield (p, q), rows, np.flatnonzero(block[rows] == i), np.flatnonzero(block[rows] == j), sets[rows], sketches[rows]


def _with_partners(shared: int, threshold: float):
    """The rows of one bucket's lists that have a partner there."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keep = np.zeros(table.num_rows, bool)
        for key, rows, a, b, sets, sketches in _lists(table):
            i, j = partners(sets, a, b, key, min(shared, sets.shape[1]), sketches, within_reach(threshold))
            keep[rows[a[i]]] = keep[rows[b[j]]] = True
        return table.filter(pa.array(keep)).select([x.split()[0] for x in _KEYED.split(", ")])

    return run


def _compare(shared: int, threshold: float):
    """The lists of one bucket -> for each class the weight of what it links with there, and forest edges."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cls, n = table["cls"].to_numpy(), table["n"].to_numpy()
        x = matrix(table["embedding"].combine_chunks())
        weight = np.zeros(len(cls), np.int64)
        forest = []
        for key, rows, a, b, sets, sketches in _lists(table):
            s, t = links_within(x[rows], sets, a, b, key, min(shared, sets.shape[1]), threshold, sketches)
            np.add.at(weight, rows[s], n[rows[t]])
            np.add.at(weight, rows[t], n[rows[s]])
            forest += [(cls[rows[u]], cls[rows[v]]) for u, v in _forest(s, t)]
        some = np.flatnonzero(weight)
        got, inverse = np.unique(cls[some], return_inverse=True)
        total = np.zeros(len(got), np.int64)
        np.add.at(total, inverse, weight[some])
        pairs = list(dict.fromkeys(forest))
        return pa.table({"a": pa.array([*got.tolist(), *(int(u) for u, _ in pairs)], pa.int64()), "b": pa.array([None] * len(got) + [int(v) for _, v in pairs], pa.int64()), "links": pa.array([*total.tolist(), *[None] * len(pairs)], pa.int64())})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    # What sums of squares overflow on is rescaled later: each component alone has to be finite.
    usable = F.coalesce((F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(usable, e.cast("array<double>")).alias("embedding"))
    rows = rows.withColumn("h", F.struct(F.xxhash64("embedding").alias("x"), F.xxhash64(F.lit(7), "embedding").alias("y"), F.size("embedding").alias("dim")))
    classes = rows.filter("embedding is not null").groupBy("h").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    # A class has a number, fixed once it is written, as vec_id may be null or repeated.
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cls"), "h", "n", "least", "embedding"), "vector-classes")
    links, forests = [], []
    for dim, count in [(r["dim"], r["count"]) for r in classes.groupBy(F.col("h.dim").alias("dim")).count().collect()]:  # a row for each length of vectors
        same = classes.filter(F.col("h.dim") == dim).select("cls", "n", "embedding")
        sample = same.orderBy(F.xxhash64("embedding", F.lit(3))).limit(SAMPLE).select("embedding").toArrow()
        k = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, math.sqrt(count / 2))))
        picked = matrix(sample["embedding"].combine_chunks())
        index = spark.sparkContext.broadcast((farthest_first(picked, k), axes(picked)))
        posted = materialize(same.select("cls", "embedding").mapInArrow(_post(index, NEAREST), _LISTED), "vector-lists")
        full = posted.groupBy("p", "q").count().filter(F.col("count") > BLOCK).select(F.col("p").alias("fp"), F.col("q").alias("fq"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        cut = posted.join(full, (F.col("p") == F.col("fp")) & (F.col("q") == F.col("fq")), "left").drop("fp", "fq")
        cut = cut.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(9)), F.col("blocks")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        buckets = 16 * partitions(spark)
        bucket = F.pmod(F.xxhash64("p", "q", "i", "j"), F.lit(buckets)).cast("int").alias("bucket")
        # All lists of a bucket are one task's; a list is at most two blocks.
        names = [x.split()[0] for x in _KEYED.split(", ")]
        met = materialize(cut.select(bucket, *names).groupBy("bucket").applyInArrow(_with_partners(SHARED, threshold), _KEYED), "vector-partners")
        fetched = met.join(same.select(F.col("cls").alias("c"), "n", "embedding"), F.col("c") == F.col("cls"))
        out = fetched.select(bucket, *names, "n", "embedding").groupBy("bucket").applyInArrow(_compare(SHARED, threshold), "a long, b long, links long")
        out = materialize(out, "vector-links")
        links.append(out.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links")))
        forests.append(out.filter("b is not null").select("a", "b"))
    if not links:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked, edges = links[0], forests[0]
    for more, also in zip(links[1:], forests[1:], strict=True):
        linked, edges = linked.unionByName(more), edges.unionByName(also)
    roots = components(edges)
    found = classes.select("h", "cls", "n", "least").join(linked, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = found.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialize(found.join(smallest, "root").select("h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "vector-found")
    out = rows.select("vec_id", F.when(F.col("embedding").isNotNull(), F.col("h")).alias("h")).join(found, "h", "left")
    alone = F.col("h").isNull()
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
