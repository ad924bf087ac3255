"""Vectors from text against numpy's decomposition of the same matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corvane import registry
from corvane.operators import lsa

SF = "/root/testdata/sf0.001"


def test_subspace_is_that_of_numpy(spark):
    """The leading directions of all documents of sf0.001, and the same numbers on other partitions."""
    n, rank = 2048, 12
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = lsa.fit(docs, rank, 12, n)
    again = lsa.fit(docs.repartition(7), rank, 12, n)
    assert np.array_equal(model["basis"], again["basis"]) and np.array_equal(model["values"], again["values"])
    rows = docs.select("doc_id", lsa.features(F.col("text"), n).alias("f")).filter(F.size("f") > 0).collect()
    counts = np.array([np.bincount(r["f"], minlength=n) for r in rows], float)
    idf = np.log1p((len(rows) + 1) / ((counts > 0).sum(0) + 1))
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model["values"][:8], s[:8], rtol=1e-3)
    # Angles between the two spaces of four directions; the fifth value is apart from the fourth.
    cosines = np.linalg.svd(model["basis"][:, :4].T @ v[:4].T)[1]
    assert cosines.min() > 0.99
    got = {r["doc_id"]: r["embedding"] for r in lsa.vectors(docs, model).collect()}
    want = x @ model["basis"]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert all(np.allclose(got[r["doc_id"]], w, atol=1e-9) for r, w in zip(rows, want, strict=True))


def test_sums_travel_packed(spark):
    """A task sends a row for each PART features and no row for each feature; stored lists give the model and vectors of their texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").coalesce(1)
    lists = lsa.listed(docs, n=512)
    held = spark.sparkContext.broadcast((np.ones(512), np.linalg.qr(np.random.default_rng(1).normal(size=(512, 6)))[0]))
    sent = lists.select("features").coalesce(1).mapInArrow(lsa._step(held), "part int, sums array<long>").collect()
    assert len(sent) == 512 // lsa.PART and all(len(r["sums"]) == 6 * lsa.PART for r in sent)
    model, again = lsa.fit_lists(lists, 4, 2, 512), lsa.fit(docs, 4, 2, 512)
    assert np.array_equal(model["basis"], again["basis"])
    assert sorted(map(str, lsa.vectors_of(lists, model).collect())) == sorted(map(str, lsa.vectors(docs, model).collect()))


def test_questions_find_their_documents(spark):
    """Most passages have a document that holds them among their eight; texts without words have no vector and are no answer."""
    hits = {}
    for r in registry.queries()["semantic_topk"](spark, SF).collect():
        hits.setdefault(r["query_id"], set()).add(r["doc_id"])
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    asked = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    held = {q: {d for d, t in docs.items() if t and p in t} for q, p in asked.items()}
    some = [q for q in held if held[q]]
    assert all(len(v) == 8 for v in hits.values()) and sum(bool(hits[q] & held[q]) for q in some) >= 0.5 * len(some)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r["embedding"] for r in lsa.vectors(odd, lsa.fit(odd, 2, 2, 64)).collect()}
    assert got[1] is None and got[2] is None and abs(sum(x * x for x in got[3]) - 1) < 1e-9
    lsa.fit(odd.limit(0), 2, 1, 64)
