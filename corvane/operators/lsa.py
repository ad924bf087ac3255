"""Vectors from text: a randomised truncated SVD of the weighted term matrix, by power iterations over the cluster.

A text's row has (1 + log count) * idf at the hash of each of its terms, FEATURES of them, and length 1. An iteration is one pass over the rows: a task
multiplies each by the present basis and adds the outer product to a sum of its own, sums meet by PART features, and the driver makes the
sum (FEATURES x (RANK + MORE) numbers, whatever the number of texts) orthonormal again. Sums are of whole numbers, in units of 1 / FIXED, so they
are the same on any partitions; they hold 2**32 texts. The last pass gives the singular values and directions by a small eigenproblem.

Texts without a term, null ones too, have a null vector. Terms may share a feature, which only their weights show.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.sources.work import written

FEATURES, RANK, MORE, ROUNDS = 1 << 15, 64, 8, 4
FIXED = 2.0**30
#: Features of a row of sums.
PART = 128


def features(text: Column, n: int) -> Column:
    return F.transform(T.tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(n)).cast("int"))


def _rows(column: pa.Array, idf: np.ndarray):
    """(first, features, weights) of a batch of lists, first being where each list's row begins; empty lists have empty rows."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    cell, count = np.unique(row * len(idf) + flat, return_counts=True)
    row, feature = np.divmod(cell, len(idf))
    weight = (1 + np.log(count)) * idf[feature]
    norm = np.sqrt(np.bincount(row, weight * weight, len(sizes)))
    return row, feature, weight / np.maximum(norm[row], 1e-300), len(sizes)


def _runs(x: np.ndarray):
    """(value, begin, end) of each run of equal values."""
    begins = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
    return zip(x[begins].tolist(), begins.tolist(), np.r_[begins, len(x)][1:].tolist(), strict=True)


def _times(row: np.ndarray, feature: np.ndarray, weight: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((n, basis.shape[1]))
    for r, a, b in _runs(row):  # a row at a time: what it needs of the basis stays in the cache
        np.dot(weight[a:b], basis[feature[a:b]], out=out[r])
    return out


def _step(held):
    """Lists -> the sum of the task's outer products with the basis, PART features to a row, those that have one."""

    def run(batches):
        idf, basis = held.value
        total = np.zeros(basis.shape, np.int64)
        for batch in batches:
            row, feature, weight, n = _rows(batch.column(0), idf)
            projected = _times(row, feature, weight, n, basis)
            order = np.argsort(feature, kind="stable")
            row, weight = row[order], FIXED * weight[order, None]
            for f, a, b in _runs(feature[order]):
                some = projected[row[a:b]]
                some *= weight[a:b]
                # Rounded one by one: the sums do not depend on what stands beside a row. Doubles hold a batch's whole numbers exactly.
                total[f] += np.rint(some, out=some).sum(0).astype(np.int64)
        for part in range(0, len(total), PART):
            sums = total[part : part + PART].ravel()
            if sums.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(sums)], pa.int32()), pa.array(sums))], names=["part", "sums"])

    return run


def _sum(table: pa.Table) -> pa.Table:
    """The sums of one part from all tasks."""
    total = sum(row.values.to_numpy() for chunk in table["sums"].chunks for row in chunk)
    return pa.table({"part": table["part"][:1], "sums": pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))})


def fit(docs: DataFrame, rank: int = RANK, rounds: int = ROUNDS, n: int = FEATURES) -> dict:
    """The model of docs(text): idf, the basis (n x rank) and its singular values, largest first."""
    return fit_lists(written(docs.select(features(F.col("text"), n).alias("features")), "lsa-features"), rank, rounds, n)


def listed(docs: DataFrame, key: str = "doc_id", n: int = FEATURES) -> DataFrame:
    """docs(key, text) -> (key, features), written: texts are taken apart once for ``fit_lists`` and ``vectors_of``."""
    return written(docs.select(key, features(F.col("text"), n).alias("features")), "lsa-features")


def fit_lists(lists: DataFrame, rank: int = RANK, rounds: int = ROUNDS, n: int = FEATURES) -> dict:
    """The model of stored lists(features), as ``fit`` has it."""
    spark, width = lists.sparkSession, rank + MORE
    lists = lists.select("features").filter(F.size("features") > 0)
    df = np.zeros(n)
    counted = lists.select(F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature").agg(F.count("*").alias("df")).toArrow()  # n rows
    df[counted["feature"].to_numpy()] = counted["df"].to_numpy()
    idf = np.log1p((lists.count() + 1) / (df + 1))
    basis, image = np.linalg.qr(np.random.default_rng(1).normal(size=(n, width)))[0], None
    for _ in range(rounds + 1):
        if image is not None:
            basis = np.linalg.qr(image)[0]
        held = spark.sparkContext.broadcast((idf, basis))  # n x width numbers
        got = lists.mapInArrow(_step(held), "part int, sums array<long>").groupBy("part").applyInArrow(_sum, "part int, sums array<long>").toArrow()  # n rows
        image = np.zeros((n, width))
        for part, sums in zip(got["part"].to_pylist(), got["sums"], strict=True):
            image[part : part + PART] = sums.values.to_numpy().reshape(-1, width) / FIXED
        held.unpersist()
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    found = basis @ turn[:, ::-1][:, :rank]
    found *= np.sign(found[np.abs(found).argmax(0), np.arange(rank)])
    return {"idf": idf, "basis": found, "values": np.sqrt(np.maximum(values[::-1][:rank], 0))}


def vectors(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """docs(key, text) -> (key, embedding): rows in the model's directions, of length 1."""
    return vectors_of(docs.select(key, features(F.col("text"), len(model["idf"])).alias("features")), model, key)


def vectors_of(lists: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """lists(key, features) -> (key, embedding)."""
    held = lists.sparkSession.sparkContext.broadcast((model["idf"], model["basis"]))
    kind = lists.schema[key].dataType.simpleString()

    def run(batches):
        idf, basis = held.value
        for batch in batches:
            x = _times(*_rows(batch.column(1), idf), basis)
            norm = np.linalg.norm(x, axis=1)
            flat = (x / np.maximum(norm, 1e-300)[:, None]).ravel()
            offsets = np.arange(len(x) + 1, dtype=np.int32) * basis.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(norm == 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "embedding"])

    return lists.select(key, "features").mapInArrow(run, f"{key} {kind}, embedding array<double>")
