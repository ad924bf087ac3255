"""Stored collections: versions, bytes that follow the change, readers beside writers, compaction, awkward keys."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.sources import collection as C


def size(root: str, *parts: str) -> int:
    return sum(p.stat().st_size for p in Path(root, *parts).rglob("*") if p.is_file())


def texts(spark, root, version=None):
    return sorted((tuple(r) for r in C.read(spark, root, "chunks", version).collect()), key=repr)


@pytest.fixture
def root(spark, tmp_path):
    """10,000 records of some 100 bytes with their vectors."""
    root = str(tmp_path / "db")
    chunks = spark.range(10_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    C.create(spark, root, {"chunks": chunks, "vectors": chunks.select("doc_id", F.array(F.rand(1), F.rand(2)).alias("embedding"))}, "doc_id", 16, 2)
    return root


def test_bytes_follow_the_change(spark, root):
    """40 of 10,000 records: an upsert writes 40, in a file for each bucket at most, and reads the buckets of its keys."""
    before = size(root)
    new = spark.range(40).select((F.col("id") * 250).alias("doc_id"), F.lit("changed").alias("text"))
    m = C.upsert(spark, root, {"chunks": new, "vectors": new.select("doc_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))}, dimension=2)
    t = m["tables"]["chunks"]
    assert (t["written"], t["deleted"], t["rows"]) == (40, 40, 10_000) and t["read"] <= 10_000
    part = t["parts"][-1]["part"]
    files = [p for p in Path(root, "tables", "chunks", f"part={part}").rglob("*.parquet")]
    assert len(files) <= 16 and sum(p.stat().st_size for p in files) < 16 * 1500 and size(root) - before < 0.2 * before
    one = C.upsert(spark, root, {"chunks": new.limit(1)})["tables"]["chunks"]
    assert one["read"] < 1000 and len(list(Path(root, "tables", "chunks", f"part={one['parts'][-1]['part']}").rglob("*.parquet"))) == 1
    assert C.read(spark, root, "chunks").filter("text = 'changed'").count() == 40 and C.read(spark, root, "vectors").count() == 10_000


def test_compaction_beside_readers(spark, root):
    new = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    C.upsert(spark, root, {"chunks": new}, spark.range(9000, 9500).select(F.col("id").alias("doc_id")))
    before, open_ = texts(spark, root), C.read(spark, root, "chunks")
    m = C.compact(spark, root)
    assert m["action"] == "compact" and not m["tables"]["chunks"]["deletes"] and len(m["tables"]["chunks"]["parts"]) == 1
    # One that was open, one of the version before, and one of the new version have the same rows.
    assert sorted((tuple(r) for r in open_.collect()), key=repr) == before == texts(spark, root) == texts(spark, root, 2)
    assert len(m["tables"]["vectors"]["deletes"]) == 1  # 5 % are not worth it
    assert len(texts(spark, root, 1)) == 10_000
    C.vacuum(spark, root, 1)
    assert texts(spark, root) == before and C.versions(spark, root) == [3] and C.read(spark, root, "vectors").count() == 9500


def test_part_of_the_buckets(spark, root):
    """Worn buckets alone are written anew."""
    keys = [r["doc_id"] for r in C.read(spark, root, "chunks").filter(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 3).limit(300).collect()]
    C.upsert(spark, root, {"chunks": spark.createDataFrame([(k, "y") for k in keys], "doc_id long, text string")})
    before, m = texts(spark, root), C.compact(spark, root)
    assert m["tables"]["chunks"]["written"] < 1000 and texts(spark, root) == before and len(m["tables"]["chunks"]["parts"]) == 2
    got = C.read(spark, root, "chunks", keys=[keys[0], keys[1], 10**9]).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(keys[:2])


def test_failures_leave_the_version(spark, root, monkeypatch):
    new = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("z").alias("text"))
    with pytest.raises(ValueError):
        C.upsert(spark, root, {"chunks": new, "vectors": new.select("doc_id", F.array(F.lit(1.0)).alias("embedding"))}, dimension=2)
    assert C.versions(spark, root) == [1] and C.read(spark, root, "chunks").filter("text = 'z'").count() == 0
    stale = C.manifest(spark, root)
    C.upsert(spark, root, {"chunks": new})
    monkeypatch.setattr(C, "manifest", lambda *a: stale)
    with pytest.raises(C.Conflict):  # a second writer that began at version 1 too
        C.upsert(spark, root, {"chunks": new})
    monkeypatch.undo()
    assert C.versions(spark, root) == [1, 2] and C.read(spark, root, "chunks").count() == 10_000
    left = C.vacuum(spark, root, 2)
    assert left and C.read(spark, root, "chunks").filter("text = 'z'").count() == 3


def test_random_changes_against_a_dict(spark, tmp_path, monkeypatch):
    """Null and repeated keys, empty changes, tables without rows; delete vectors that are not broadcast."""
    monkeypatch.setattr(C, "FEW", 0)
    r, root, held = random.Random(3), str(tmp_path / "db"), {}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = [(k, f"{k}.{j}") for k in [None, *range(12)] for j in range(2)]
    C.create(spark, root, {"chunks": frame(rows), "vectors": frame([]).select("doc_id")}, "doc_id", 4)
    for k, t in rows:
        held.setdefault(k, []).append(t)
    for step in range(4):
        changed = [(r.choice([None, *range(20)]), f"s{step}.{j}") for j in range(r.choice([0, 3, 8]))]
        gone = [(r.choice([None, *range(20)]),) for _ in range(r.choice([0, 2]))]
        C.upsert(spark, root, {"chunks": frame(changed)}, spark.createDataFrame(gone, "doc_id long"))
        for k in {x[0] for x in [*changed, *gone]}:
            held.pop(k, None)
        for k, t in changed:
            held.setdefault(k, []).append(t)
        want = sorted(((k, t) for k, ts in held.items() for t in ts), key=repr)
        assert texts(spark, root) == want
        if step % 2:
            C.compact(spark, root, parts=2)
            assert texts(spark, root) == want
    C.snapshot(spark, root, str(tmp_path / "copy"), ["chunks"])
    assert texts(spark, str(tmp_path / "copy")) == want and not (tmp_path / "copy/tables/vectors").exists()
    assert C.history(spark, root).filter("name = 'chunks'").orderBy(F.desc("version")).first()["rows"] == len(want)
