"""The corpus pipeline: each stage on literal rows, on awkward ones, and the whole against brute force."""

from __future__ import annotations

from collections import Counter

import pytest
from llm.fixtures import SCHEMA, awkward

import corpus_pipeline

SF = "/root/testdata/sf0.001"
BASE = " ".join(f"w{i}" for i in range(40))
OTHER = " ".join(f"v{i}" for i in range(40))


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("more", ["z", " ".join(f"u{i}" for i in range(30))])
def test_a_text_never_goes_with_another_of_its_id(spark, more):
    """Ids 1 and 5 share a text; 5 has a second one, which 7 holds twice: near it, or too far from it."""
    data = [(1, BASE), (5, BASE), (5, OTHER), (7, f"{OTHER} {more}"), (7, f"{OTHER} {more}")]
    out = rows(corpus_pipeline.keep_one_of_group(spark, spark.createDataFrame(data, "doc_id long, text string").repartition(3), SF))
    assert sorted(out) == [(1, BASE), (5, OTHER)] + ([(7, f"{OTHER} {more}")] if more != "z" else [])


def test_repeated_rows_and_null_ids(spark):
    data = [(None, BASE, 2), (None, BASE, 1), (None, OTHER, 3), (None, None, 4), (None, None, 4), (3, "", 5), (3, "", 5), (9, OTHER, 6), (9, OTHER, 6)]
    out = rows(corpus_pipeline.keep_one_of_group(spark, spark.createDataFrame(data, "doc_id long, text string, k int").repartition(3), SF))
    assert len(out) == 6 and Counter(r[0] for r in out) == {None: 3, 3: 2, 9: 1} and {r[2] for r in out if r[1] == BASE} <= {1, 2}


CLASHING = {"kept": "y", "size": 7, "n_words": "w", "n_lines": 2.5, "lines_removed": "none", "n_shingles": None, "sig": 1, "component_id": "c", "copies": 9, "taken": -1, "target": "t", "base_failed": 0, "distance2": "far", "shard": 4, "first": "f", "text_key": "k", "__row_key": "r", "KEPT_sha256": "s"}


def test_clashing_columns_come_back(spark):
    data = [(i, f"{BASE} own{i} {OTHER}\nline {i}", "en", "s", 0, *CLASHING.values()) for i in range(3)] + [(8, " ".join(f"t{k}" for k in range(60)), None, None, None, *CLASHING.values())]
    schema = "doc_id long, text string, lang string, source string, n_chars int, kept string, size int, n_words string, n_lines double, lines_removed string, n_shingles int, sig int, component_id string, copies int, taken int, target string, base_failed int, distance2 string, shard int, first string, text_key string, __row_key string, KEPT_sha256 string"
    docs = spark.createDataFrame(data, schema).repartition(2)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema or [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        found = out.collect()
        assert found and all({k: r[k] for k in CLASHING} == CLASHING for r in found)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4


def test_stages_on_awkward_rows(spark):
    """What each stage does to rows that fail, repeat or are empty."""
    docs = spark.createDataFrame(awkward(), SCHEMA).repartition(2)
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        counts[name] = stage(spark, docs, SF).count()
        assert stage(spark, docs.limit(0), SF).count() == 0
    n = len(awkward())
    wordless = sum(not (r[1] or "").encode().split() for r in awkward())
    assert counts["BPE encoding and decoding"] == n and counts["quality rules"] < n - wordless
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_group(spark, docs, SF).collect()}
    assert {(4, None), (5, ""), (6, " \n\t "), (None, None), (19, "\n\n\n")} <= kept and (2, awkward()[1][1]) not in kept and (8, "a") not in kept


def test_whole_pipeline_against_brute_force(spark):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import hashlib

    import numpy as np
    from llm import brute
    from llm.fixtures import components, jaccard_links, shingles
    from tokenizers import Tokenizer

    from corvane.llm import bpe

    docs = sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    docs = [d for d, k in zip(docs, brute.quality([d[1:] for d in docs]), strict=True) if k]
    docs = [(d[0], t, *d[2:]) for d, (t, n) in zip(docs, brute.lines([d[:2] for d in docs]), strict=True) if not (n and t == "")]
    sets = [shingles(d[1], 5) for d in docs]
    docs = [d for k, (d, c) in enumerate(zip(docs, components(len(docs), jaccard_links(sets, 80)), strict=True)) if k == c]
    docs = [d for d, n in zip(docs, brute.mix([(d[0], d[1], d[3]) for d in docs]), strict=True) for _ in range(n)]
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    want = []
    for d in docs:
        ids = lib.encode(d[1], add_special_tokens=False).ids
        want.append((d[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert want and sorted(rows(corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))) == sorted(want)
