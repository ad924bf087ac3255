"""Large clusters of near copies in the n-gram join: they meet through what differs from one of them.

A cluster's pivot is the class nearest to what most of a few of its classes have. Classes linked with the pivot are one component; a pair of these needs
no look. Any other pair x, y that is linked has a class, x say, that isn't linked with the pivot p. With D for what is in one of a set and p but not
in both, x and y share |D(x) & D(y)| + |x & p| + |y & p| - |p| n-grams, so a link asks for t(x, y) = needed - |x & p| - |y & p| + |p| n-grams in both
differences, never less than 1 here. As in every prefix filter, the first |D| - t + 1 of both then meet, in any order that all share: what p lacks comes
first, rarest first, and is a copy's own as a rule, so that copies which aren't linked hardly ever meet, however many there are.

t(x, y) is at least needed(x, p) - |x & p| for the class that isn't linked with p (the long part of its difference), and for the other one, against any class that isn't
linked with p, |p| - |y & p| + 1 + floor((|y| - |p|) * percent / (100 + percent)) (the short part).
Classes that aren't linked with p and meet in a column of over FULL of them are clusters again, with a pivot of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import lean, materialize
from corvane.llm.components import components
from corvane.llm.wordhash import mix

#: Classes that name a cluster's middle; the pivot is then sought among all of its classes, and results depend on neither.
SOME = 64
FULL = 1024
PARITY = 8
_U = np.uint64
_PARTS = "root long, pivot long, sig long, near boolean, n int, both int, m int, size int, parity array<long>, diff binary"
_ENTRIES = "root long, gram long, place int, sig long, near boolean, short boolean, n int, both int, m int, size int"


def _grams(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), _U)


def _parity(gram: np.ndarray) -> np.ndarray:
    """64 * PARITY bits: whether an odd number of the n-grams falls on them."""
    odd = np.bincount((mix(gram) % _U(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _middle(table: pa.Table) -> pa.Table:
    gram, count = np.unique(np.concatenate([_grams(x) for x in table["grams"]]), return_counts=True)
    return pa.table({"root": table["root"][:1], "middle": pa.array([gram[2 * count > len(table)].tobytes()], pa.binary())})


@lean
def _far(batches):
    for batch in batches:
        far = [len(np.setxor1d(_grams(x), _grams(p), assume_unique=True)) for x, p in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.int64())], names=["root", "sig", "far"])


def _differ(percent: int, counts: np.ndarray):
    """(root, pivot, sig, grams, p) -> _PARTS: how each class differs from its pivot, and whether they are linked."""
    shared = counts

    def ordered(gram, table):
        return gram[np.lexsort((gram, table[gram >> _U(44)]))]

    @lean
    def run(batches):
        table = shared.value
        for batch in batches:
            out = []
            for x, p in zip(batch.column(3), batch.column(4), strict=True):
                x, p = _grams(x), _grams(p)
                more, less = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
                both = len(p) - len(less)
                diff = np.concatenate([ordered(more, table), ordered(less, table)])
                out.append((100 * both >= percent * (len(x) + len(p) - both), len(x), both, len(p), len(diff), _parity(diff), diff.tobytes()))
            near, n, both, m, size, parity, diff = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(near, pa.bool_()), *[pa.array(c, pa.int32()) for c in (n, both, m, size)], pa.array(parity, pa.list_(pa.int64())), pa.array(diff, pa.binary())], names=[c.split()[0] for c in _PARTS.split(", ")]
            )

    return run


def _entries(percent: int):
    """_PARTS -> a row for each n-gram of a difference's short part, and of the long part too where the class isn't linked with its pivot."""

    @lean
    def run(batches):
        for batch in batches:
            near = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            n, both, m, size = (batch.column(k).to_numpy().astype(np.int64) for k in (4, 5, 6, 7))
            least = np.maximum(1, m - both + 1 + (percent * (n - m)) // (100 + percent))
            short = np.clip(size - least + 1, 0, size)
            alone = np.clip(size - (-(-percent * (n + m) // (100 + percent)) - both) + 1, 0, size)
            length = np.where(near, short, np.maximum(short, alone))
            if not length.sum():
                continue
            row = np.repeat(np.arange(len(n)), length)
            place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            gram = np.concatenate([_grams(x)[:k] for x, k in zip(batch.column(9), length.tolist(), strict=True) if k]).view(np.int64)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(gram), pa.array(place.astype(np.int32)), batch.column(2).take(at), pa.array(near[row]), pa.array(place < short[row]), *[batch.column(k).take(at) for k in (4, 5, 6, 7)]],
                names=[c.split()[0] for c in _ENTRIES.split(", ")],
            )

    return run


@lean
def _shared(batches):
    """(a, b, t, diff of a, diff of b) -> the pairs that share t n-grams of their differences."""
    for batch in batches:
        keep = [len(np.intersect1d(_grams(x), _grams(y), assume_unique=True)) >= t for t, x, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


def _needed(x: str, y: str, percent: int) -> str:
    """t(x, y) in SQL."""
    return f"(({percent} * ({x}.n + {y}.n) + {99 + percent}) div {100 + percent} - {x}.both - {y}.both + {x}.m)"


def _met(left: DataFrame, right: DataFrame, percent: int, more: str = "true") -> DataFrame:
    """Pairs that meet in a column where enough of both differences is left."""
    x, y = left.alias("x"), right.alias("y")
    enough = f"least(x.size - x.place, y.size - y.place) >= {_needed('x', 'y', percent)} AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    pairs = x.join(y, F.expr(f"x.root = y.root AND x.gram = y.gram AND {enough} AND {more}"))
    return pairs.selectExpr("x.root AS root", "x.sig AS a", "y.sig AS b", f"{_needed('x', 'y', percent)} AS t").distinct()


def family_links(cluster: DataFrame, sets: DataFrame, counts, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """cluster(root, node), sets(sig, grams) -> (links (a, b) that join what is linked in these clusters, but for pairs inside the second: (root, node),
    the clusters that are left to be looked at). counts is a broadcast sketch of how often n-grams occur."""
    sized = cluster.groupBy("root").agg(F.count("*").alias("members"))
    placed = cluster.join(sized, "root").withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("members") / block)))
    held = materialize(placed.withColumnRenamed("node", "sig").join(sets, "sig").select("root", "part", "members", "sig", "grams"), "family-sets")
    # A centre for each part of a cluster, so that no task meets all of it.
    parts = sized.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / block) - 1))).select("root", "part")
    some = held.filter((F.pmod(F.xxhash64("sig", F.lit(7)), F.col("members")) < SOME) | (F.col("sig") == F.col("root")))
    middles = some.select("root", "grams").groupBy("root").applyInArrow(_middle, "root long, middle binary").join(parts, "root")
    far = held.join(middles, ["root", "part"]).select("root", "sig", "grams", "middle").mapInArrow(_far, "root long, sig long, far long")
    pivots = far.groupBy("root").agg(F.min_by("sig", F.struct("far", "sig")).alias("pivot"))
    pivots = materialize(pivots.join(sets, F.col("pivot") == F.col("sig")).select("root", "pivot", F.col("grams").alias("p")), "family-pivots").join(parts, "root")
    differing = held.join(pivots, ["root", "part"]).select("root", "pivot", "sig", "grams", "p").mapInArrow(_differ(percent, counts), _PARTS)
    differing = materialize(differing, "family-differences")
    entries = materialize(differing.mapInArrow(_entries(percent), _ENTRIES), "family-columns")
    far_short, column = entries.filter("short AND NOT near"), ["root", "gram"]
    full = materialize(far_short.groupBy(*column).agg(F.count("*").alias("k"), F.min("sig").alias("least")).filter(F.col("k") > FULL), "family-full")
    # Either both aren't linked with the pivot, or one is.
    apart = far_short.join(full, column, "left_anti")
    found = _met(apart, apart, percent, "x.sig < y.sig").union(_met(entries.filter("NOT near"), entries.filter("near AND short"), percent))
    # Differences differ in as many n-grams as their parities differ in bits, or more.
    first, second = (differing.select("root", F.col("sig").alias(k), F.col("size").alias(f"s{k}"), F.col("parity").alias(f"p{k}")) for k in "ab")
    unlike = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    found = found.join(first, ["root", "a"]).join(second, ["root", "b"]).filter(unlike <= F.col("sa") + F.col("sb") - 2 * F.col("t"))
    found = materialize(found.select("root", "a", "b", "t"), "family-pairs")
    da, db = (differing.select("root", F.col("sig").alias(k), F.col("diff").alias(f"d{k}")) for k in "ab")
    links = found.join(da, ["root", "a"]).join(db, ["root", "b"]).select("a", "b", F.col("t").cast("long"), "da", "db").mapInArrow(_shared, "a long, b long")
    links = links.union(differing.filter("near AND sig != pivot").select(F.col("pivot").alias("a"), F.col("sig").alias("b")))
    rest = components(far_short.join(full, column).select(F.col("least").alias("a"), F.col("sig").alias("b")).filter("a != b"))
    rest = rest.unionByName(rest.select(F.col("root").alias("node"), "root").distinct())
    return materialize(links, "family-links"), materialize(rest.select("root", "node"), "family-rest")
