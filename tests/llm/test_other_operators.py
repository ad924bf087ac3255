"""Chat windows, embeddings, components, induction and the pipeline."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from llm.fixtures import components

import corpus_pipeline
from corvane.llm import chat, embeddings, induction, queries
from corvane.llm.components import components as spark_components

SF = "/root/testdata/sf0.001"


def digests(turns):
    out = {}
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=order)
        said = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)
        out[conv] = (len(mine), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


TURNS = [
    (1, 0, "system", "be kind"), *[(1, k, "user" if k % 2 else "assistant", f"turn {k} " * (k % 7 + 1)) for k in range(1, 60)],
    (2, 0, "user", None), (2, 1, None, "x"), (2, 1, None, "x"), (2, None, "assistant", "first"), (None, 0, "assistant", "null id"), (3, 0, "assistant", "<turn user>\\[INST] </turn>\n\\"),
    (3, 1, "a<b>\\[", "日本 <s>"), (4, 0, "assistant", "w " * 5000), (4, 1, "assistant", "after"), (5, 0, "assistant", ""), (6, 0, "system", "only"),
]


@pytest.mark.parametrize("stride,history", [(1024, 256), (20, 10), (5, 0)])
def test_chat(spark, stride, history):
    df = spark.createDataFrame([(*t, "extra") for t in TURNS], "conv_id long, turn long, role string, text string, window string").repartition(3)
    windows = chat.format_windows(df, stride, history)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(windows).collect()}
    assert got == digests(TURNS)
    rows = windows.collect()
    if stride == 20:
        mine = sorted((r for r in rows if r["conv_id"] == 1), key=lambda r: r["window"])
        assert len(mine) > 3 and all(chat.parse(r["formatted"])[0] == ("system", "be kind") for r in mine) and any(r["n_repeated"] > 1 for r in mine)


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_windows(df)).count() == 0


def test_chat_query(spark):
    turns = [tuple(r) for r in chat.conversations(spark, SF).collect()]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.queries()["op5_chat_windows"](spark, SF).collect()}
    assert got == digests(turns) and -7 in got


def brute_vectors(x, least=0.95):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    return near.sum(1), components(len(x), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])


@pytest.mark.parametrize("block", [1024, 5])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    r = np.random.default_rng(6)
    base = r.normal(size=(40, 16))
    x = np.concatenate([base, base[:10].repeat(6, 0) + 0.1 * r.normal(size=(60, 16)), base[:1].repeat(20, 0)])
    data = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    odd = [(900, None, ""), (901, [0.0] * 16, ""), (902, [float("nan")] + [1.0] * 15, ""), (903, [None] + [1.0] * 15, ""), (904, [float("inf")] + [1.0] * 15, ""), (905, [], ""), (906, [1.0, 2.0], ""), (907, [2.0, 4.0], ""), (908, [1e300] * 16, ""), (909, [1e-300] * 16, "")]
    out = {q["vec_id"]: q for q in embeddings.near_vectors(spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, n string").repartition(3)).collect()}
    links, roots = brute_vectors(np.concatenate([x, np.ones((2, 16))]))
    found = np.array([out[i]["n_links"] for i in [*range(len(x)), 908, 909]])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum() and [out[i]["component_id"] for i in range(len(x))] == roots[: len(x)]
    for i in (900, 901, 902, 903, 904, 905):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert (out[906]["n_links"], out[907]["component_id"], out[907]["kept"]) == (1, 906, False)


def test_vectors_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_vectors(spark.createDataFrame([], schema)).count() == 0
    out = embeddings.near_vectors(spark.createDataFrame([(1, [1.0, 0.0])] * 3 + [(None, [1.0, 0.0]), (None, None)], schema)).collect()
    assert sorted((r["vec_id"] is None, r["n_links"]) for r in out) == [(False, 3)] * 3 + [(True, 0), (True, 3)]


def test_sketches_rule_out_no_link():
    r = np.random.default_rng(3)
    for dim in (2, 16, 64, 300):
        x = r.normal(size=(300, dim))
        x = np.concatenate([x, x + 0.3 * r.normal(size=x.shape) * r.uniform(0, 1, (300, 1))])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        basis = embeddings.axes(x[:100])
        s = np.zeros((600, embeddings.SKETCH))
        s[:, : basis.shape[1]] = np.rint(127 * (x @ basis))
        far = ((s[:, None] - s[None]) ** 2).sum(2)
        assert (far[x @ x.T >= 0.95] <= embeddings.within_reach(0.95)).all()


def test_vector_recall(spark):
    """Thousands of links with cosines from 0.95 to 0.99, of which nine in ten at least must be found and none too many; and the tables'
    own vectors, which have no link."""
    r = np.random.default_rng(11)
    base = r.normal(size=(4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = r.normal(size=base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = r.uniform(0.95, 0.99, (4000, 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * noise])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    found = {q["vec_id"]: q["n_links"] for q in embeddings.near_vectors(df).collect()}
    links, _ = brute_vectors(x)
    got = np.array([found[i] for i in range(len(x))])
    assert links.sum() >= 7000 and (got <= links).all() and got.sum() >= 0.9 * links.sum()
    own = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {q["vec_id"]: q["n_links"] for q in embeddings.near_vectors(own).collect()}
    data = own.orderBy("vec_id").collect()
    assert [rows[q["vec_id"]] for q in data] == brute_vectors(np.array([q["embedding"] for q in data], float))[0].tolist()


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 40)], [(i, 99 - i) for i in range(50)] + [(3, 3)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in spark_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    roots = components(100, edges)
    assert got == {v: roots[v] for v in range(100) if roots[v] != v}


def test_induction():
    r = random.Random(1)
    for k in range(600):
        text = [r.randint(1, r.choice([1, 2, 4, 200])) for _ in range(r.randint(0, 60))]
        text = (text[:10] * 4 if k % 4 == 0 else text) + [0]
        cap = r.choice([1, 3, 8, 100])
        order = sorted(range(len(text)), key=lambda i: text[i:])
        shared = [0] + [next((n for n in range(cap) if text[a + n] != text[b + n]), cap) for a, b in zip(order, order[1:])]
        rank, common = induction.suffix_order(np.array(text, np.int64), cap, 7 if k % 3 == 0 else 1 << 20)
        assert rank[order].tolist() == list(range(len(text))) and common.tolist() == shared


def test_induction_ranks_few_tuples(monkeypatch):
    """Naming LMS substrings takes their own symbols, not an induction of all suffixes."""
    r = random.Random(3)
    text = np.array([r.choice(b"etaoin shrdlu") for _ in range(20000)] + [0], np.int64)
    queued, queue = [], induction.ordered
    monkeypatch.setattr(induction, "ordered", lambda key, memory: (queued.append(len(key)), queue(key, memory))[1])
    induction.suffix_order(text, 400, 1 << 20)
    assert sum(queued) < 7 * len(text)


def test_wide_keys_are_ranked_alike():
    """Keys that leave no room for a place beside them in one word."""
    key = np.random.default_rng(3).integers(0, 50, 3000) << 56
    for memory in (100, 1 << 20):
        rank, ranked, place = induction.ordered(key, memory)
        assert rank.tolist() == np.unique(key, return_inverse=True)[1].tolist() and ranked.tolist() == sorted(key.tolist()) == key[place].tolist()


def test_external_ranks():
    key = np.random.default_rng(2).integers(0, 500, 5000)
    assert induction.ranks(key, 100).tolist() == np.unique(key, return_inverse=True)[1].tolist()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        assert name == corpus_pipeline.STAGES[-1][0] or after.columns == columns
        if "quality" in name:
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            from corvane.llm.quality import with_stats

            failed = {r["doc_id"] for r in with_stats(before).filter("base_failed").collect()}
            kept = {r["doc_id"] for r in after.collect()}
            assert all((i in kept) == (q == 1) for i, q in labels.items() if i not in failed) and not kept & failed
        before = after
    assert before.count() > 0


def test_line_stage_takes_short_lines(spark):
    """Lines of one to nine words between unique ones: all later copies go, and unique lines stay."""
    shorts = ["Share", "Read more here", "one two three four five six seven eight nine"]
    data = [(i, "\n".join(x for k, s in enumerate(shorts) for x in (f"own line {i} {k} of this one document and no other", s))) for i in range(4)]
    out = {r["doc_id"]: r["text"].split("\n") for r in corpus_pipeline.keep_first_lines(spark, spark.createDataFrame(data, "doc_id long, text string").repartition(3), SF).collect()}
    assert out[0] == data[0][1].split("\n")
    assert all(out[i] == [x for x in data[i][1].split("\n") if x not in shorts] for i in range(1, 4))


def test_release(spark):
    import os

    from corvane.llm import common

    kept = common.materialize(spark.range(3), "release")
    path = kept.inputFiles()[0].split("://")[-1].rsplit("/", 1)[0]
    path = "/" + path.lstrip("/").removeprefix("localhost/")
    assert os.path.isdir(path)
    common.release(spark)
    assert not os.path.isdir(path)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from corvane.llm import common

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(RuntimeError):
            common.work_dir(spark, "x")
