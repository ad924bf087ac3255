"""Toxicity, hard negatives and conversation repair: brute force, held-out accuracy and awkward rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from compare import differences
from llm import brute
from llm.fixtures import SCHEMA, awkward

from corvane.llm import negatives, oracles, queries, repair, toxicity

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# Toxicity


def test_fold():
    assert toxicity.fold("You ID1OT, сlown!  $tupid\n1234 y$$$ tr4sh$$$") == " you idiot clown stupid 1234 y trash "
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold(" !? \n") == " "
    assert toxicity.fold("ｓｃｕｍ réeux") == " scum réeux "


def test_matcher_and_exceptions():
    m = toxicity.Matcher({" scum ": 4.0, " moro": 2.0}, [" pond scum ", " morocco "])
    assert m.density(" you scum ") == 4.0 / (2 + toxicity.SHORT)
    assert m.density(" pond scum morocco ") == 0
    assert [w for _, _, w in m.spans(" scum pond scum moron morocco scum ")] == [4.0, 2.0, 4.0]
    assert toxicity.Matcher({}).density(" anything ") == 0
    assert set(toxicity.phrases(" a pond scum b ", toxicity.Matcher({" scum ": 1.0}))) == {" scum ", " pond scum ", " scum b "}


def test_lexicon_learns_phrases_too(spark):
    """A word of toxic texts that clean ones have in one phrase alone: the word is learnt and the phrase let off."""
    toxic = [(i, f"plain words of text {i} and a vile thing here") for i in range(40)]
    clean = [(100 + i, f"plain words of text {i} and more {i} of them") for i in range(80)] + [(300 + i, f"some other words {i} with vile weather there") for i in range(8)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in toxic + clean], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert any(x.startswith(" vile") or x.startswith(" thing") for x in model["weights"]) and not any("plain" in x for x in model["weights"])
    asked = spark.createDataFrame([(1, "you are a v1le thing, a vile one"), (2, "vile weather there"), (3, ""), (4, None), (5, "plain words")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(asked, model).collect()}
    assert got[1] >= 0.5 > got[2] and got[3] == got[4] == got[5] <= got[2] < got[1]


def test_held_out(spark):
    """Held-out labels of sf0.01: nearly no clean text is called toxic, and most toxic ones are."""
    found = {r["doc_id"]: r for r in queries.queries()["op11_toxicity"](spark, LARGER).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    held = [(found[i]["predicted"], found[i]["score"], t) for i, t in labels.items() if found[i]["held_out"]]
    hit = sum(p and t for p, _, t in held)
    assert hit >= 0.75 * sum(t for *_, t in held) and hit >= 0.9 * sum(p for p, *_ in held)
    pairs = [(s > q) + 0.5 * (s == q) for _, s, t in held if t for _, q, u in held if not u]
    assert sum(pairs) / len(pairs) >= 0.85
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found.values())


def test_hidden_words_are_found(spark):
    """Toxic documents of sf0.01 with look-alike letters and digits in their words score as before."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{LARGER}/labels.parquet"))
    shown = {r["doc_id"]: r for r in toxicity.score(docs, model).collect() if r["score"] >= 0.5}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in shown}
    odd = str.maketrans({"o": "о", "c": "с", "e": "е"})  # Cyrillic
    hidden = spark.createDataFrame([(i, t.translate(odd)) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(hidden, model).collect()}
    assert len(shown) > 40 and all(abs(got[i] - r["score"]) < 1e-9 for i, r in shown.items())


def test_toxicity_on_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, 0.0, 1) for r in awkward()] + [(99, "w " * 400_000, "en", "s", 1, 1, "", 0.0, 1, "", 1, 0.0, 1)], SCHEMA + ", score double, weight int").repartition(3)
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (2, None, "x"), (None, 1, "x"), (3, 0, "x"), (777, 1, "x")], "doc_id long, toxic int, text string")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    bare = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert len({r["score"] for r in bare}) == 1 and bare[0]["score"] < 0.5
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


# Hard negatives


def test_negatives_equal_sql(spark):
    assert differences(queries.queries()["op12_hard_negatives"](spark, LARGER), oracles.OP12, LARGER) == ""


VECTORS = "vec_id long, label int, embedding array<double>, score string, rank int, slot int"


@pytest.mark.parametrize("rows,sparse", [(4096, 16), (7, 1)])
def test_negatives_brute(spark, monkeypatch, rows, sparse):
    """Small blocks, ties, repeated rows, several lengths, large components, null and non-finite ones."""
    from corvane.operators import blocks

    monkeypatch.setattr(blocks, "ROWS", rows)
    monkeypatch.setattr(negatives, "SPARSE", sparse)
    r = np.random.default_rng(5)
    data = [(i, int(r.integers(0, 3)), (r.integers(-3, 4, 6) / (1 if i % 2 else 256)).tolist()) for i in range(120)]
    data += [(200 + i, i % 2, [float(i), 1.0]) for i in range(12)] + [(300 + i, i % 2, []) for i in range(4)] + [(i, i % 3, [3.0] * 6) for i in range(20)]
    data += [(400, 1, None), (401, None, [1.0] * 6), (402, 1, [1.0] * 5 + [None]), (403, 1, [float("nan")] * 6), (404, 0, [float("inf")] * 6), (None, 1, [2.0] * 6), (405, 0, [60000.0] * 6), (406, 0, [1e300] * 6), (-5, 1, [-1.5] * 6)]
    data += data[:3]
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in data], VECTORS).repartition(3)
    got = sorted((tuple(x) for x in negatives.mine(df, df.filter("vec_id % 5 = 0")).collect()), key=repr)
    assert got == sorted(brute.negatives(data, 5), key=repr) and len(got) > 50


def test_negatives_empty(spark):
    df = spark.createDataFrame([], VECTORS)
    assert negatives.mine(df, df).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0], "", 1, 1)], VECTORS)
    assert negatives.mine(one, one).count() == 0 and negatives.mine(df, one).count() == 0


def test_planes_drop_pairs():
    """Most pairs are out before the last plane, and no pair with one of the best scores is."""
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    ends, left = np.full(50, negatives.NONE), []

    def stays(i, j, low, high):
        exact = (x[i] * x[j]).sum(1)
        assert (low <= exact).all() and (exact <= high).all()
        np.maximum(ends, negatives.kth_best(i, low, 50, 5), out=ends)
        left.append(int((high >= ends[i]).sum()))
        return high >= ends[i]

    i, j, score = negatives.Products(x[:50], x, np.ones((50, 2000), bool)).run(stays)
    assert left[-3] < 0.2 * 50 * 2000
    for k in range(50):
        assert sorted(score[i == k])[-5:] == sorted(x[k] @ x.T)[-5:]


# Conversation repair

COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def repaired(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("sf", [SF, LARGER])
def test_repair_query(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(queries.queries()["op13_conversation_repair"](spark, sf)) == brute.repairs(brute.damage(turns))


@pytest.mark.parametrize("segment", [1024, 5, 1])
def test_repair_brute(spark, segment):
    """One conversation with most of the rows, cut into segments of many tasks; odd roles, ties, nulls, blank and very long texts."""
    r = random.Random(4)
    texts = [None, "", "a.", "b", "c!", "  ", "d? ", "é", "same.", "\x0b.\t", "long words " * 20_000]
    turns = [(c, r.choice([None, *range(40)]), r.choice(["user", "assistant", "system", "user", "assistant", "", None, "tool"]), r.choice(texts[:-1])) for c in [None, *range(9)] for _ in range(r.choice([1, 3, 10, 60]))]
    turns += [(77, k, ("user", "assistant")[k % 2] if r.random() < 0.8 else "system", f"t{k}." if r.random() < 0.8 else "x") for k in range(600)] + [(78, None, "user", "alike.")] * 50 + [(79, 1, "user", texts[-1])]
    df = spark.createDataFrame([(*t, "x", 7) for t in turns], "conv_id long, turn long, role string, text string, audit string, place int").repartition(5)
    assert repaired(repair.repair(df, segment)) == brute.repairs([(c, t, r or (" " if r is None else ""), " " if x is None else x) for c, t, r, x in turns])


def test_search_is_cheapest():
    """A* against all sequences of edits of up to four rows."""
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(0, 4)
        initials, faults = [r.choice("suax") for _ in range(n)], [r.choice(["", "", "blank", "duplicate", "truncated"]) for _ in range(n)]
        (got,) = repair.search(initials, faults).values()
        assert got == brute.cheapest(initials, faults)


def test_repair_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(df).count() == 0 and repair.repair(repair.damaged(df)).count() == 0
