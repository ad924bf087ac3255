"""Operator 7: n-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

A document's set is its distinct word n-grams. Documents with one set are one class and the join runs on classes.

Rows of the incidence are ordered by how often an n-gram occurs (a count sketch of fixed size), rarest first. Two sets
that are similar enough share an n-gram among the first |x| - ceil(percent |x| / 100) + 1 of each, so only these columns
bring candidates together, and a pair is dropped at once where sizes, or what is left of both sets from the shared
column on, or parity bitmaps bound the overlap below what is needed. Columns with up to LIST classes give pairs, which are verified on whole sets.
A column that is
fuller within a task already sends one class for all of them, so no task meets a group of documents. The classes of fuller columns are gathered in clusters, a cluster is cut into blocks of BLOCK classes, and a task multiplies
one pair of blocks: overlap counts add up over column slices, pairs are never written out, only a spanning forest of
the links is. Clusters of over a block meet through what differs from one of them first (``families.py``), as products grow with the square of a cluster. Components come from all links.

Null or empty texts have no n-grams, size 0, and link with nothing, each its own component; texts shorter than n words
are one n-gram. Rows with one doc_id and text are one document; a null doc_id never is the smallest, and has a null
component if nothing else is reached. Rows that share a doc_id but not a text are documents of their own, told apart by
``text_key``. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import as_bytes
from corvane.llm.common import documents, lean, materialize, partitions
from corvane.llm.components import components
from corvane.llm.families import family_links
from corvane.llm.wordhash import Chunk, chunks, mix, planes, unplanes

WIDTH, PERCENT = 5, 80
CELLS = 1 << 20
BLOOM_BITS = 1 << 24
LIST = 24
PARITY = 16
BLOCK = 1024
SLICE = 4096
CHUNK = 1 << 19
_U = np.uint64


def text_key(text: Column) -> Column:
    """Tells the texts of one doc_id apart: the 128 bits of md5, of null as of the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def needed(a, b, percent: int):
    """The least overlap of sets of a and b n-grams that makes 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def all_grams(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of all n-grams of some texts, repeated ones too."""
    c = Chunk(texts, lower=True)
    place = np.flatnonzero(c.valid(width))
    doc = np.repeat(np.arange(len(texts)), c.sizes)[place]
    gram = c.windows(width)[place]
    short = np.flatnonzero((c.sizes > 0) & (c.sizes < width))
    if len(short):
        whole = np.array([xxhash.xxh3_64_intdigest(b" ".join(texts[i].lower().split()), 11) for i in short], _U)
        doc, gram = np.concatenate([doc, short]), np.concatenate([gram, whole])
    return doc, gram


def in_order(doc: np.ndarray, rank: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
    """The order by (doc, rank, gram), of docs below n. One sort by as much of them as 64 bits hold decides, if it tells all apart that differ."""
    bits = max(1, (n - 1).bit_length())
    key = (doc.astype(_U) << _U(64 - bits)) | (rank >> _U(bits))
    order = np.argsort(key)
    ranked = key[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if (gram[order[same]] != gram[order[same + 1]]).any():
        return np.lexsort((gram, rank, doc))
    return order


class Grams:
    """The distinct n-grams of some texts: text i has gram[first[i]:first[i + 1]], in the order of ``rank``, rarest first."""

    def __init__(self, texts: list[bytes | None], width: int, counts: np.ndarray | None = None):
        doc, gram = all_grams(texts, width)
        rank = gram if counts is None else (np.minimum(counts[gram >> _U(44)], (1 << 20) - 1).astype(_U) << _U(44)) | (gram & _U((1 << 44) - 1))
        order = in_order(doc, rank, gram, len(texts))
        doc, gram = doc[order], gram[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
        self.gram, doc = gram[new], doc[new]
        self.first = np.searchsorted(doc, np.arange(len(texts) + 1))
        self.sizes = np.diff(self.first)
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(self.gram))])
        self.doc = doc
        self.signature = (mix(total[self.first[1:]] - total[self.first[:-1]] + self.sizes.astype(_U)) >> _U(1)).astype(np.int64)


    def parities(self) -> list[list[int]]:
        """Of each text 64 * PARITY bits: whether an odd number of its n-grams falls on them."""
        out, bits = [], 64 * PARITY
        for a in range(0, len(self.sizes), 1024):
            b = min(a + 1024, len(self.sizes))
            part = slice(self.first[a], self.first[b])
            cell = (self.doc[part] - a) * bits + (mix(self.gram[part]) & _U(bits - 1)).astype(np.int64)
            odd = (np.bincount(cell, minlength=(b - a) * bits) & 1).astype(np.uint8)
            out += np.packbits(odd).view(np.int64).reshape(b - a, PARITY).tolist()
        return out


def count_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How many n-grams, repeated ones too, fall into each of CELLS cells, over all documents: CELLS numbers, whatever the input."""
    pieces = 64

    @lean
    def run(batches):
        total, held, size = np.zeros(CELLS, np.uint32), [], 0
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in chunks(texts, CHUNK):
                held.append((all_grams(texts[a:b], width)[1] >> _U(44)).astype(np.int64))
                size += len(held[-1])
                if size > CELLS:
                    total += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([planes(x) for x in np.split(total, pieces)], pa.binary())], names=["piece", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // pieces, np.int64)
        for raw in table["counts"].to_pylist():
            total += unplanes(raw, np.uint32)
        return pa.table({"piece": table["piece"][:1], "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(run, "piece int, counts binary").groupBy("piece").applyInArrow(add, "piece int, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in sorted(rows, key=lambda r: r["piece"])]) if rows else np.zeros(CELLS, np.uint32)


_LISTED = "doc_id long, text_key binary, n long, sig long, parity array<long>, bucket int, grams binary, sigs binary, sizes binary, places binary"


def _list_columns(docs: DataFrame, width: int, percent: int, counts: Broadcast, buckets: int) -> DataFrame:
    """A row for each document (n and sig), and packed rows for each bucket of leading columns."""
    shift = _U(64 - (buckets - 1).bit_length())

    @lean
    def run(batches):
        table = counts.value
        held, size, seen = [], 0, set()

        def rows(bucket, packed):
            none = pa.nulls(len(bucket), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.nulls(len(bucket), pa.binary()), none, none, pa.nulls(len(bucket), pa.list_(pa.int64())), pa.array(bucket, pa.int32()), *(pa.array(c, pa.binary()) for c in packed)], names=[x.split()[0] for x in _LISTED.split(", ")])

        def flush():
            gram, sig, n, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(gram)
            gram, sig, n, place = gram[order], sig[order], n[order], place[order]
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            size = np.diff(np.append(first, len(gram)))
            hot = size > LIST
            if hot.any():  # full here already: its classes are tied to one of them, which goes on with size 0
                inside = np.repeat(hot, size)
                least = np.minimum.reduceat(sig, first)[hot]
                yield rows([-1], [[planes(np.repeat(least, size[hot]))], [planes(sig[inside])], [b""], [b""]])
                pivots = gram[first[hot]]
                gram, sig = np.concatenate([gram[~inside], pivots]), np.concatenate([sig[~inside], least])
                n, place = (np.concatenate([x[~inside], np.zeros(len(pivots), np.uint32)]) for x in (n, place))
                order = np.argsort(gram)
                gram, sig, n, place = gram[order], sig[order], n[order], place[order]
            rims = np.searchsorted((gram >> shift).astype(np.int64), np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(rims))
            cols = [[planes(v[rims[b] : rims[b + 1]]) for b in used] for v in (sig, n, place)]
            grams = [planes(np.diff(gram[rims[b] : rims[b + 1]], prepend=_U(0))) for b in used]
            yield rows(used, [grams, *cols])

        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), as_bytes(batch.column(2))
            for a, b in chunks(texts, CHUNK):
                g = Grams(texts[a:b], width, table)
                m = b - a
                empty = [pa.nulls(m, t) for t in (pa.int32(), *[pa.binary()] * 4)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, m), keys.slice(a, m), pa.array(g.sizes.astype(np.int64)), pa.array(g.signature), pa.array(g.parities(), pa.list_(pa.int64())), *empty], names=[x.split()[0] for x in _LISTED.split(", ")])
                if len(seen) > 1 << 20:
                    seen.clear()
                fresh = np.array([s not in seen and not seen.add(s) for s in g.signature.tolist()], bool) & (g.sizes > 0)
                lead = np.where(fresh, g.sizes - -(-percent * g.sizes // 100) + 1, 0)
                doc = np.repeat(np.arange(m), lead)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(lead) - lead, lead)
                held.append((g.gram[g.first[doc] + place], g.signature[doc], g.sizes[doc].astype(np.uint32), place.astype(np.uint32)))
                size += len(doc)
                if size > 1 << 18:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text").mapInArrow(run, _LISTED)


def _meet(percent: int):
    """Columns of one bucket -> pairs of classes (kind 0), or star edges of the classes in full columns (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda name, kind: [unplanes(x, kind) for x in table[name].to_pylist()]
        gram = np.concatenate([np.cumsum(x) for x in read("grams", _U)])
        sig, n, place = np.concatenate(read("sigs", np.int64)), np.concatenate(read("sizes", np.uint32)).astype(np.int64), np.concatenate(read("places", np.uint32)).astype(np.int64)
        order = np.lexsort((n, sig, gram))  # size 0 first: it stands for more classes
        gram, sig, n, place = gram[order], sig[order], n[order], place[order]
        keep = np.ones(len(gram), bool)
        keep[1:] = (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])
        gram, sig, n, place = gram[keep], sig[keep], n[keep], place[keep]
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(gram)))
        full = (size > LIST) | (np.minimum.reduceat(n, first) == 0) if len(gram) else size > LIST
        found = []
        for k in np.unique(size[(size > 1) & ~full]):  # all lists of one length at once
            at = first[(size == k) & ~full]
            i, j = np.triu_indices(k, 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            need = needed(n[x], n[y], percent)
            ok = np.minimum(n[x] - place[x], n[y] - place[y]) >= need
            ok &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            found.append((sig[x[ok]], sig[y[ok]], np.zeros(int(ok.sum()), np.int32)))
        for at, k in zip(first[full], size[full], strict=True):
            # Those that could meet no other member of the list stay out.
            m = n[at : at + k]
            left = np.where(m == 0, 1 << 40, m - place[at : at + k])
            possible = np.minimum(left, left.max()) >= needed(m, -(-percent * m // 100), percent)
            s = sig[at : at + k][possible]
            if len(s) > 1:
                found.append((np.full(len(s) - 1, s.min()), np.delete(s, s.argmin()), np.ones(len(s) - 1, np.int32)))
        a, b, kind = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        if len(a):
            pairs = np.unique(np.rec.fromarrays([a, b, kind], names="a,b,kind"))
            a, b, kind = pairs["a"], pairs["b"], pairs["kind"]
        return pa.table({"a": pa.array(a), "b": pa.array(b), "kind": pa.array(kind)})

    return run


@lean
def _tied(batches):
    """Rows of classes that were tied before they were sent."""
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unplanes(a, np.int64)), pa.array(unplanes(b, np.int64))], names=["a", "b"])


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sig, grams) of the wanted classes. One text of each class is taken apart; a Bloom filter of fixed size over their hashes spares
    most other texts that."""
    chosen = rows.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("text_key").alias("text_key"))
    name = F.xxhash64("text_key")
    # Names are hashes: their low bits are the filter's.
    bit = F.pmod(name, F.lit(BLOOM_BITS))
    cells = chosen.select(F.floor(bit / 32).cast("int").alias("cell"), (bit % 32).cast("int").alias("at")).select("cell", F.expr("shiftleft(1L, at)").alias("bit"))
    filled = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()  # BLOOM_BITS / 32 rows at most
    bloom = np.zeros(BLOOM_BITS // 32, np.uint32)
    bloom[filled["cell"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    @lean
    def run(batches):
        bits = shared.value
        for batch in batches:
            cell = batch.column(0).to_numpy() & (BLOOM_BITS - 1)
            some = np.flatnonzero((bits[cell >> 5] >> (cell & 31).astype(np.uint32)) & np.uint32(1))
            texts = as_bytes(batch.column(1).take(pa.array(some)))
            for a, b in chunks(texts, CHUNK):
                g = Grams(texts[a:b], width)
                once = np.unique(g.signature, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(g.signature[once]), pa.array([g.gram[g.first[k] : g.first[k + 1]].tobytes() for k in once], pa.binary())], names=["sig", "grams"])

    sifted = docs.select(F.xxhash64(text_key(F.col("text"))).alias("name"), "text").mapInArrow(run, "sig long, grams binary")
    return sifted.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.first("grams").alias("grams"))


def _verify(percent: int):
    @lean
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                shared = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def product_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets left and right: overlaps add up over slices of columns."""
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    alone = count[col] == 1
    row, col = row[~alone], col[~alone]
    rest = np.bincount(row, minlength=len(sets))  # entries of each set in the columns still to come
    used = np.unique(col)
    col = np.searchsorted(used, col)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    overlap = np.zeros((len(left), len(right)), np.float32)
    need = needed(sizes[left][:, None], sizes[right][None, :], percent)
    alive_l, alive_r = np.arange(len(left)), np.arange(len(right))
    for start in range(0, len(used), SLICE):
        a, b = np.searchsorted(col, [start, start + SLICE])
        x = np.zeros((len(sets), min(SLICE, len(used) - start)), np.float32)
        x[row[a:b], col[a:b] - start] = 1
        overlap[np.ix_(alive_l, alive_r)] += x[left[alive_l]] @ x[right[alive_r]].T
        rest = rest - np.bincount(row[a:b], minlength=len(sets))
        possible = overlap + np.minimum(rest[left][:, None], rest[right][None, :]) >= need
        alive_l, alive_r = np.flatnonzero(possible.any(1)), np.flatnonzero(possible.any(0))
        if not len(alive_l):
            break
    shared = overlap.astype(np.int64)
    linked = 100 * shared >= percent * (sizes[left][:, None] + sizes[right][None, :] - shared)
    parent = list(range(len(sets)))

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    forest = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = root(int(left[i])), root(int(right[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            forest.append((int(left[i]), int(right[j])))
    return forest


def _multiply(percent: int):
    def run(table: pa.Table) -> pa.Table:
        sig, block = table["sig"].to_numpy(), table["block"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), _U) for x in table["grams"]]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        forest = product_links(sets, np.flatnonzero(block == i), np.flatnonzero(block == j), percent)
        return pa.table({"a": pa.array([sig[x] for x, _ in forest], pa.int64()), "b": pa.array([sig[y] for _, y in forest], pa.int64())})

    return run


def near_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, sig, component_id, first) for every row of docs; first marks the rows of a component's smallest
    (doc_id, text_key), null ids last."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    buckets = 1 << (2 * partitions(spark) - 1).bit_length()
    counts = spark.sparkContext.broadcast(count_sketch(docs, width))
    listed = materialize(_list_columns(docs, width, percent, counts, buckets), "ngram-columns")
    rows = listed.filter("bucket is null").select("doc_id", "text_key", "n", "sig")
    tied = listed.filter("bucket < 0").select("grams", "sigs").mapInArrow(_tied, "a long, b long").filter("a != b").distinct()
    columns = listed.filter("bucket >= 0").select("bucket", "grams", "sigs", "sizes", "places")
    met = materialize(columns.groupBy("bucket").applyInArrow(_meet(percent), "a long, b long, kind int").distinct(), "ngram-met")
    pairs, stars = met.filter("kind = 0").select("a", "b"), met.filter("kind = 1").select("a", "b").union(tied)
    inside = components(stars)
    cluster = materialize(inside.unionByName(inside.select(F.col("root").alias("node"), "root").distinct()), "ngram-clusters")
    # A pair inside a cluster is part of its product.
    ca, cb = (cluster.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
    outside = pairs.join(ca, "a", "left").join(cb, "b", "left").filter("ra is null or rb is null or ra != rb").select("a", "b")
    # Sets differ in as many n-grams as their parities differ in bits, or more.
    traits = listed.filter("n > 0").select("sig", "n", "parity").dropDuplicates(["sig"])
    ta, tb = (traits.select(F.col("sig").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}")) for k in "ab")
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    total = F.col("na") + F.col("nb")
    possible = (total - apart) * (100 + percent) >= 2 * percent * total
    outside = materialize(outside.join(ta, "a").join(tb, "b").filter(possible).select("a", "b"), "ngram-pairs")
    wanted = outside.select(F.col("a").alias("sig")).union(outside.select("b")).union(cluster.select("node")).distinct()
    sets = materialize(_sets(docs, rows, materialize(wanted, "ngram-wanted"), width), "ngram-sets")

    left, right = sets.select(F.col("sig").alias("a"), F.col("grams").alias("x")), sets.select(F.col("sig").alias("b"), F.col("grams").alias("y"))
    near = outside.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")

    # Clusters of over a block are recentred on one of their classes; what that leaves, and the others, are multiplied.
    work, links = [], near
    while True:
        sized = cluster.groupBy("root").agg(F.count("*").alias("members"))
        large = materialize(cluster.join(sized.filter(F.col("members") > BLOCK), "root", "left_semi").select("root", "node"), "ngram-large")
        members = large.count()
        if not members or (work and 10 * members > 9 * before):
            work.append(cluster)
            break
        work.append(cluster.join(sized.filter(F.col("members") <= BLOCK), "root", "left_semi"))
        found, cluster = family_links(large, sets, counts, percent, BLOCK)
        before, links = members, links.union(found)
    for cluster in work:
        counted = cluster.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        placed = cluster.join(counted, "root").select("root", "blocks", F.col("node").alias("sig"), F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int").alias("block"))
        spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", "sig", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        tasks = spread.join(sets, "sig").groupBy("root", "i", "j")
        links = links.union(tasks.applyInArrow(_multiply(percent), "a long, b long"))

    roots = components(links)
    # By class, then by row: tables that are written first meet in joins whose hot keys Spark can split.
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min(place).alias("least"))
    rooted = materialize(classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")), "ngram-roots")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component")), "ngram-least")
    named = materialize(rooted.join(least, "root").select("sig", "component"), "ngram-named")
    out = rows.join(named, "sig", "left")
    linked = F.col("n") > 0
    return out.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "sig", F.when(linked, F.col("component.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, place.eqNullSafe(F.col("component"))).otherwise(F.lit(True)).alias("first"),
    )


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_documents(documents(spark, sf_dir), 4, 85).select("doc_id", "n_shingles", "component_id")
