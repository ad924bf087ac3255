"""Stored indexes against the lanes that read everything."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ann, inverted, lanes, strings
from corvane.plans import fusion


def rows(df):
    return sorted(map(tuple, df.collect()))


def zipf(n: int, words: int, seed: int):
    r = random.Random(seed)
    ranks = [f"w{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return [(i, " ".join(r.choices(ranks, weights, k=r.randint(20, 60)))) for i in range(n)]


def test_few_blocks_are_read(spark, tmp_path):
    """Questions of some rare and some very common words over 20,000 texts: the answers of the full scan from less than three in ten of their blocks."""
    docs = spark.createDataFrame(zipf(20_000, 3000, 1), "doc_id long, text string").repartition(4)
    r = random.Random(2)
    asked = [(q, " ".join(f"w{k}" for k in [*r.sample(range(80, 400), 3), *range(3)])) for q in range(30)]
    questions = spark.createDataFrame(asked, "query_id long, text string")
    inverted.build(docs, str(tmp_path / "index"))
    top, reads = inverted.search(spark, str(tmp_path / "index"), questions)
    assert rows(top) == rows(lanes.lexical(docs, questions))
    got = reads.agg(F.sum("blocks").alias("all"), F.sum("blocks_read").alias("read")).first()
    assert got["read"] < 0.3 * got["all"]


def test_index_edges(spark, tmp_path):
    """Null and empty texts, equal texts that tie, unknown words, questions without a word, more results asked than there are."""
    data = [(1, "a b c"), (2, "a b c"), (3, None), (4, ""), (5, "A a a d"), (6, "!?"), (7, "ärger b")] + [(100 + k, "a x") for k in range(40)]
    docs = spark.createDataFrame([(*d, "z") for d in data], "doc_id long, text string, term string")
    questions = spark.createDataFrame([("q1", "a"), ("q2", "b c nowhere"), ("q3", "nowhere"), ("q4", ""), ("q5", None), ("q6", "a b c d x Ärger ä")], "query_id string, text string")
    inverted.build(docs, str(tmp_path / "index"), span=2, buckets=3)
    for k in (2, 1000):
        top, reads = inverted.search(spark, str(tmp_path / "index"), questions, k)
        assert rows(top) == rows(lanes.lexical(docs, questions, k))
    assert {r["query_id"] for r in reads.collect()} == {"q1", "q2", "q6"}
    assert spark.read.parquet(str(tmp_path / "index/blocks")).agg(F.max("n")).first()[0] < 20  # a word of most texts is many blocks


def test_postings_are_no_rows(spark, tmp_path, monkeypatch):
    """A term is one row for each segment of documents, however many blocks it has there; questions that are too many for a broadcast have the same answers."""
    docs = spark.createDataFrame(zipf(3000, 300, 4), "doc_id long, text string").coalesce(2)
    questions = spark.createDataFrame([(q, f"w{q} w{7 * q} w0 w1") for q in range(25)], "query_id long, text string")
    path = str(tmp_path / "index")
    inverted.build(docs, path)
    per_term = spark.read.parquet(f"{path}/blocks").filter("term IS NOT NULL").groupBy("term").count()
    assert per_term.agg(F.max("count")).first()[0] <= 2
    want = rows(lanes.lexical(docs, questions))
    assert rows(inverted.search(spark, path, questions)[0]) == want
    monkeypatch.setattr(inverted.packs, "FEW", 0)
    monkeypatch.setattr(inverted.packs, "QUESTIONS", 10)
    assert rows(inverted.search(spark, path, questions)[0]) == want


def test_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    inverted.build(docs, str(tmp_path / "index"))
    assert inverted.search(spark, str(tmp_path / "index"), spark.createDataFrame([(1, "a")], "query_id long, text string"))[0].count() == 0


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def test_quantised_index(spark, tmp_path):
    """12,000 vectors in groups of neighbours: nine in ten of the ten nearest from an eighth of the cells, all of them where exact; every row is in it."""
    r = np.random.default_rng(3)
    x = (r.normal(size=(600, 1, 32)) + 0.35 * r.normal(size=(600, 20, 32))).reshape(-1, 32)
    v = vectors(spark, x)
    path = str(tmp_path / "index")
    ann.build(v, path)
    assert spark.read.parquet(f"{path}/vectors").count() == 12_000 == spark.read.parquet(f"{path}/codes").agg(F.sum(F.size("ids"))).first()[0]
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = {(q, d) for q, _, d, _ in rows(lanes.dense(v, asked, 10))}
    got = rows(ann.search(spark, path, asked, 10))
    assert len({(q, d) for q, _, d, _ in got} & want) >= 0.9 * len(want) == 0.9 * 1200
    assert rows(ann.search(spark, path, asked, 10, exact=True)) == rows(lanes.dense(v, asked, 10))


def test_questions_of_a_cell_share_its_codes(spark):
    """A hundred questions of a cell are one block, not a block each, each with a copy of the cell's codes."""
    to = spark.range(300).selectExpr("id DIV 3 AS query_id", "array(1D) AS embedding", "CAST(id % 3 AS int) AS cell", "CAST(NULL AS double) AS least")
    assert sorted((r["cell"], len(r["asked"])) for r in ann._grouped(to, 1).collect()) == [(c, 100) for c in range(3)]


def test_index_of_odd_vectors(spark, tmp_path, monkeypatch):
    """Null, zero and non-finite vectors, a third of all alike, fewer than asked for; lengths that differ; an empty table."""
    monkeypatch.setattr(ann, "BLOCK", 16)
    x = np.concatenate([np.random.default_rng(1).normal(size=(60, 5)), np.ones((40, 5))])
    odd = spark.createDataFrame([(900, None), (901, [0.0] * 5), (902, [float("nan")] * 5), (903, [None] * 5), (904, [1e300] * 5), (905, [])], "vec_id long, embedding array<double>")
    v = vectors(spark, x).unionByName(odd)
    ann.build(v, str(tmp_path / "index"))
    asked = v.filter("vec_id % 7 = 0 OR vec_id >= 900").select(F.col("vec_id").alias("query_id"), "embedding")
    for k in (3, 500):
        assert rows(ann.search(spark, str(tmp_path / "index"), asked, k, exact=True)) == rows(lanes.dense(v, asked, k))
    with pytest.raises(ValueError):
        ann.build(v.unionByName(vectors(spark, np.ones((1, 3)), 990)), str(tmp_path / "other"))
    ann.build(v.limit(0), str(tmp_path / "none"))
    assert ann.search(spark, str(tmp_path / "none"), asked).count() == 0


def test_many_strings(spark):
    """100,000 strings over texts that hold some of them, by one broadcast, by shards that are not broadcast, and by plain search."""
    r = random.Random(5)
    texts = ["".join(r.choices("abcd é", k=r.randint(0, 400))) for _ in range(60)] + [None, ""]
    asked = [(q, "".join(r.choices("abcd é", k=r.randint(7, 12)))) for q in range(100_000)]
    cut = [t[k : k + 9] for t in texts[:60] for k in range(0, max(0, len(t) - 9), 50)]
    asked += [(200_000 + k, s) for k, s in enumerate(cut)] + [(300_000, None), (300_001, " "), (300_002, ""), (300_003, cut[0]), (300_004, "a")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, sought string").repartition(3)
    questions = spark.createDataFrame(asked, "query_id long, text string").repartition(4)
    want = {(q, i) for q, s in asked if s and s.strip() for i, t in enumerate(texts) if t and s in t}
    for chars, few in ((1 << 20, 4 << 20), (1 << 18, 0)):
        got = rows(strings.holders(docs, questions, chars, few))
        assert len(got) == len(set(got)) and set(got) == want
    plan = strings.holders(docs, questions, 1 << 18, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" in plan
    assert strings.holders(docs, questions.limit(0)).count() == 0 == strings.holders(docs.limit(0), questions).count()


def test_questions_are_not_copied_beside_rows(spark):
    """A few questions reach a worker once: no join repeats all of them on each document, or on each block of a partition, in what Python is handed."""
    docs = spark.createDataFrame([(i, f"word{i % 7} and word{i % 5}") for i in range(40)], "doc_id long, text string")
    questions = spark.createDataFrame([(q, f"word{q} and") for q in range(9)], "query_id long, text string")
    v = vectors(spark, np.random.default_rng(3).normal(size=(30, 4)))
    asked = v.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    for found in (strings.holders(docs, questions), lanes.lexical(docs, questions), lanes.dense(v, asked)):
        assert found.count() > 0 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_hits_alone(spark):
    """Chunks and content hashes are made of the documents that are hits, each once."""
    hits = spark.createDataFrame([(1, 3), (2, 3), (2, 5), (3, -1)], "query_id long, doc_id long")
    assert sorted(r["doc_id"] for r in fusion.documents_of(spark, "/root/testdata/sf0.001", hits).collect()) == [3, 5]
