"""A stored index of vectors: an inverted file with product quantisation, exact scores for its candidates, and exact answers where asked for.

Build: centroids of cells, and codebooks for what is left of a vector beside its centroid, are fitted to the SAMPLE vectors of the smallest hashes; every
usable vector is indexed, as the cell of its nearest centroid, a code of one byte for each of PARTS pieces, and the length of what the code
leaves out. Cells are folders, so that a probe reads those it asks for; a cell of a third of all vectors is many files and blocks of codes.

Search: a question probes its nearest cells. A code and a question's tables give a score whose distance from the cosine is no more than what the code
leaves out; candidates are the rows whose upper ends reach the k-th best lower end (``exact``) or those of the ``rerank`` best scores. Their
vectors are read from the candidates' cells, and cosines in double precision decide. With ``exact`` a second probe takes every other
cell that its radius doesn't rule out, so the answers are those of ``lanes.dense``; without, recall is measured in the tests.

Vectors that are null or zero, or have null or non-finite components or such a norm, are in no index and answer nothing. All vectors of an index have one length;
others are an error. vec_id is a key and not null; a vector isn't an answer to the question of its own id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators.lanes import ranked
from corvane.sources.work import written

SAMPLE = 16_384
LEAST_CELLS, MOST_CELLS = 8, 4096
PARTS, CODES = 16, 256
ROUNDS = 10
#: Codes of a block, about.
BLOCK = 8192
PROBES, RERANK = 8, 128
#: Questions of a block, about.
QUESTIONS = 128
#: More than double precision and six places can be off.
SLACK = 2e-6


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim) if len(column) else np.zeros((0, dim))
    x = x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clusters(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k centres of the rows of x by Lloyd's rounds; an empty one moves to the row farthest from its own."""
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near, far = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its squared distance."""
    near, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for s in range(0, len(x), 4096):
        d = (centres * centres).sum(1) - 2 * x[s : s + 4096] @ centres.T
        near[s : s + 4096] = d.argmin(1)
        far[s : s + 4096] = d.min(1) + (x[s : s + 4096] ** 2).sum(1)
    return near, np.maximum(far, 0)


def fit(x: np.ndarray, rows: int, parts: int = PARTS) -> dict:
    """Centroids and codebooks from a sample of unit vectors; the number of cells follows from that of all rows."""
    dim = x.shape[1]
    centres = clusters(x, int(min(MOST_CELLS, max(LEAST_CELLS, math.sqrt(rows)), max(1, len(x)))))
    near, _ = nearest(x, centres)
    rest, cuts = x - centres[near], np.linspace(0, dim, min(parts, dim) + 1).astype(int)
    books = [clusters(rest[:, a:b], CODES, seed=2 + a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return {"dim": dim, "centres": centres, "cuts": cuts, "books": books}


def encode(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, codes, length of what the codes leave out) of unit vectors."""
    cell, _ = nearest(x, model["centres"])
    rest, codes, cuts = x - model["centres"][cell], [], model["cuts"]
    left = np.zeros(len(x))
    for book, a, b in zip(model["books"], cuts, cuts[1:], strict=False):
        code, far = nearest(rest[:, a:b], book)
        codes.append(code)
        left += ((rest[:, a:b] - book[code]) ** 2).sum(1)
    return cell, np.stack(codes, 1).astype(np.uint8), np.sqrt(left)


def _usable(vectors: DataFrame, *keep: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    good = vectors.filter(F.col("embedding").isNotNull()).select(*keep, e.alias("embedding"))
    return good.filter((F.size("embedding") > 0) & V.finite(F.col("embedding")) & (V.norm(F.col("embedding")) > 0) & (V.norm(F.col("embedding")) < float("inf")))


def build(vectors: DataFrame, path: str, parts: int = PARTS) -> None:
    """Of vectors(vec_id, embedding), below path, with a byte for each of ``parts`` pieces: the model, code blocks by cell, vectors by cell, and the radius of each cell."""
    spark = vectors.sparkSession
    rows = _usable(vectors, "vec_id")
    sizes = rows.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if sizes["n"] and sizes["a"] != sizes["b"]:
        raise ValueError(f"vectors of {sizes['a']} to {sizes['b']} components")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    dim = sizes["a"] or 1
    model = fit(_unit(sample, dim), sizes["n"], parts) if len(sample) else {"dim": 1, "centres": np.zeros((0, 1)), "cuts": np.array([0, 1]), "books": [np.zeros((0, 1))]}
    held = spark.sparkContext.broadcast(model)  # MOST_CELLS centroids and PARTS books of CODES entries

    def coded(batches):
        for batch in batches:
            x = _unit(batch.column(1), dim)
            cell, codes, left = encode(x, held.value)
            far = np.linalg.norm(x - held.value["centres"][cell], axis=1)
            packed = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), packed, pa.array(left), pa.array(far), batch.column(1)], names=["cell", "vec_id", "code", "rest", "far", "embedding"])

    found = written(rows.mapInArrow(coded, f"cell int, vec_id {kind}, code binary, rest double, far double, embedding array<double>"), "ann-coded")
    found.select("cell", "vec_id", "embedding").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    cells = found.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    cells = written(cells, "ann-cells")
    placed = found.join(F.broadcast(cells), "cell")  # MOST_CELLS rows
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    blocks = placed.groupBy("cell", "block").agg(F.collect_list(F.struct("vec_id", "code", "rest")).alias("rows"))
    blocks = blocks.select("cell", F.col("rows.vec_id").alias("ids"), F.col("rows.code").alias("codes"), F.col("rows.rest").alias("rests"))
    blocks.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/codes")
    radius = dict.fromkeys(range(len(model["centres"])), -1.0) | {r["cell"]: r["radius"] for r in cells.collect()}
    stored = {"centres": model["centres"].tobytes(), "cuts": model["cuts"].astype(np.int64).tobytes(), "radius": np.array([radius[c] for c in range(len(radius))]).tobytes()}
    row = (dim, kind, *[bytearray(x) for x in stored.values()], [bytearray(b.tobytes()) for b in model["books"]])
    spark.createDataFrame([row], "dim int, kind string, centres binary, cuts binary, radius binary, books array<binary>").write.parquet(f"{path}/model")


def _model(spark: SparkSession, path: str) -> dict:
    r = spark.read.parquet(f"{path}/model").first()
    cuts = np.frombuffer(r["cuts"], np.int64)
    books = [np.frombuffer(b, np.float64).reshape(-1, w) for b, w in zip(r["books"], np.diff(cuts).tolist(), strict=True)]
    return {"dim": r["dim"], "kind": r["kind"], "centres": np.frombuffer(r["centres"], np.float64).reshape(-1, r["dim"]), "radius": np.frombuffer(r["radius"], np.float64), "cuts": cuts, "books": books}


def _cells(held, probes: int, exact: bool):
    """(query_id, embedding, least) -> (query_id, embedding, cell, least): the cells to probe. least null: the nearest ``probes``; else all others
    that may hold a score of that much."""

    def run(batches):
        m = held.value
        for batch in batches:
            q = _unit(batch.column(1), m["dim"])
            near = q @ m["centres"].T
            order = np.argsort(-near, axis=1, kind="stable")
            first = np.zeros(near.shape, bool)
            np.put_along_axis(first, order[:, :probes], True, 1)
            least = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            # A row of a cell is its centroid and a rest no longer than the radius.
            some = first if not exact else ~first & (near + m["radius"] >= np.where(np.isnan(least), -np.inf, least)[:, None])
            i, cell = np.nonzero(some & (m["radius"] >= 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(cell.astype(np.int32)), batch.column(2).take(pa.array(i))], names=["query_id", "embedding", "cell", "least"])

    return run


def _scores(held, k: int, rerank: int, exact: bool):
    """Blocks of questions with blocks of codes of their cell -> the rows that may be among the k best of a question, with both ends of their scores."""

    def run(batches):
        m = held.value
        for batch in batches:
            for r in range(batch.num_rows):
                asked, ids = batch.column(1)[r].values, batch.column(2)[r].values
                codes = np.frombuffer(b"".join(batch.column(3)[r].values.to_pylist()), np.uint8).reshape(len(ids), -1)
                rests, cell = batch.column(4)[r].values.to_numpy(), batch.column(0)[r].as_py()
                queries = asked.field("query_id")
                q = _unit(asked.field("embedding"), m["dim"])
                # What the codes stand for, once for all questions of the block.
                score = q @ (m["centres"][cell] + np.concatenate([book[codes[:, p]] for p, book in enumerate(m["books"])], 1)).T
                low, high = score - rests - SLACK, score + rests + SLACK
                known = pc.unique(queries)
                mine, theirs = pc.index_in(queries, value_set=known).to_numpy(), pc.index_in(ids.cast(queries.type), value_set=known).fill_null(-1).to_numpy()
                own = theirs[None, :] == mine[:, None]
                n = min(k if exact else rerank, len(ids))
                ends = np.where(own, -np.inf, low if exact else score)
                least = np.partition(ends, len(ids) - n, axis=1)[:, len(ids) - n]
                if exact:  # what the question has already
                    least = np.fmax(least, asked.field("least").to_numpy(zero_copy_only=False).astype(float))
                i, j = np.nonzero(~own & ((high if exact else score) >= least[:, None]))
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(i)), pa.array(np.full(len(i), cell), pa.int32()), ids.take(pa.array(j)), pa.array(score[i, j]), pa.array(low[i, j]), pa.array(high[i, j])], names=["query_id", "cell", "doc_id", "near", "low", "high"])

    return run


def _grouped(to: DataFrame, n_groups: int) -> DataFrame:
    """Questions of a cell in blocks, as many as all questions fill, so that codes are read once for a block and not for a question."""
    part = F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).alias("part")
    return to.groupBy("cell", part).agg(F.collect_list(F.struct("query_id", "embedding", "least")).alias("asked"))


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = 10, probes: int = PROBES, rerank: int = RERANK, exact: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score) of questions(query_id, embedding)."""
    m = _model(spark, path)
    held = spark.sparkContext.broadcast(m)
    kind, id_type = questions.schema["query_id"].dataType.simpleString(), m["kind"]
    asked = _usable(questions, "query_id").filter(F.size("embedding") == m["dim"])
    if not len(m["centres"]):
        return spark.createDataFrame([], f"query_id {kind}, rank long, doc_id {id_type}, score double")
    codes = spark.read.schema(f"ids array<{id_type}>, codes array<binary>, rests array<double>, cell int").parquet(f"{path}/codes")

    n_groups = max(1, -(-asked.count() // QUESTIONS))

    def probe(asked: DataFrame, rest: bool) -> DataFrame:
        to = asked.mapInArrow(_cells(held, probes, rest), f"query_id {kind}, embedding array<double>, cell int, least double")
        to = _grouped(to, n_groups)
        pairs = to.select("cell", "asked").join(codes, "cell").select("cell", "asked", "ids", "codes", "rests")
        got = pairs.mapInArrow(_scores(held, k, rerank, exact), f"query_id {kind}, cell int, doc_id {id_type}, near double, low double, high double")
        return written(got, "ann-near")

    def kth(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("low").desc(), "doc_id")
        return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") == k).select("query_id", F.col("low").alias("least"))

    found = probe(asked.withColumn("least", F.lit(None).cast("double")), False)
    if exact:
        found = found.unionByName(probe(asked.join(kth(found), "query_id", "left"), True))
        found = found.join(kth(found), "query_id", "left").filter("least IS NULL OR high >= least").drop("least")
    else:
        found = ranked(found.withColumnRenamed("near", "score"), rerank)
    wanted = written(found.select("query_id", "cell", "doc_id"), "ann-candidates")
    cells = [r[0] for r in wanted.select("cell").distinct().collect()]  # MOST_CELLS numbers at most
    stored = spark.read.schema(f"vec_id {id_type}, embedding array<double>, cell int").parquet(f"{path}/vectors").filter(F.col("cell").isin(cells))
    mine = asked.select("query_id", F.col("embedding").alias("q"))
    met = stored.join(wanted, (stored["cell"] == wanted["cell"]) & (stored["vec_id"] == wanted["doc_id"])).select("query_id", "doc_id", "embedding").join(mine, "query_id")
    scored = met.select("query_id", "doc_id", F.round(V.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    return ranked(scored, k).select("query_id", "rank", "doc_id", "score")
