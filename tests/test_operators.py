"""Edge cases of the engine's operators on literal rows."""

from __future__ import annotations

import io
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import evaluate, features, fusion, lanes, maintenance
from corvane.plans.surface import validate
from corvane.sources import openxml, sinks


def one(spark, c, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(c).first()[0]


@pytest.mark.parametrize("name,ok", [("x-rag", True), ("x-rag\n", False), ("A-RAG", False), ("-rag", False), ("a b-rag", False), ("A.b_c-rag", True)])
def test_db_name(spark, name, ok):
    assert one(spark, F.col("x").rlike(T.DB_NAME), x=name) is ok


@pytest.mark.parametrize("question,db,code", [
    ("what", None, "ok"), ("", None, "question_blank"), (" \u3000\n", None, "question_blank"), ("a" * 16000, None, "ok"), ("a" * 16001, None, "question_too_long"),
    ("a\0b", None, "question_nul"), ("what", "x-rag\n", "database_invalid"), ("what", "x-rag", "ok"),
])
def test_validate(spark, question, db, code):
    df = spark.createDataFrame([(question, db)], "q string, db string")
    assert df.select(validate(F.col("q"), F.col("db"))).first()[0] == code


def test_casefold(spark):
    assert one(spark, T.casefold(F.col("x")), x="Straße") == one(spark, T.casefold(F.col("x")), x="STRASSE")


@pytest.mark.parametrize("glob,path,hit", [("fr/**", "fr/a/b", True), ("*.html", "a/b.html", False), ("a/?.txt", "a/b.txt", True), ("a/?.txt", "a/bb.txt", False)])
def test_glob(spark, glob, path, hit):
    assert one(spark, F.col("x").rlike(T.glob_regex(glob)), x=path) is hit


@pytest.mark.parametrize("glob", ["/a", "C:/a", "\\\\host\\a", "a/../b"])
def test_absolute_globs_are_refused(glob):
    with pytest.raises(ValueError):
        T.glob_regex(glob)


@pytest.mark.parametrize("n,starts", [(0, []), (1, [0]), (100, [0]), (1400, [0]), (1401, [0, 1240]), (2640, [0, 1240]), (2641, [0, 1240, 2480])])
def test_chunks(spark, n, starts):
    df = features.chunks(spark.createDataFrame([(1, "x" * n)], "doc_id long, text string"))
    rows = df.orderBy("chunk_index").collect()
    assert [r["start"] for r in rows] == starts
    assert not rows or rows[-1]["start"] + len(rows[-1]["chunk"]) == n


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0]), ([float("nan"), 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.finite(F.col("a")).alias("f")).collect()
    assert rows[0]["c"] is None and rows[1]["c"] == pytest.approx(1) and [r["f"] for r in rows] == [True, True, False]


def test_exact_lane_has_no_fallback(spark):
    p = spark.createDataFrame([(1, "k", "RFC1", 2)], "doc_id long, kind string, identifier string, n long")
    q = spark.createDataFrame([(1, "RFC999999"), (2, "RFC1")], "query_id long, identifier string")
    assert [(r["query_id"], r["doc_id"]) for r in lanes.exact(p, q).collect()] == [(2, 1)]


def test_neighbours_are_not_hits(spark):
    hits = spark.createDataFrame([(1, 7, 1), (1, 7, 2)], "query_id long, doc_id long, chunk_index long")
    chunks = spark.createDataFrame([(7, i) for i in range(5)], "doc_id long, chunk_index long")
    assert {r["chunk_index"] for r in fusion.neighbours(hits, chunks).collect()} == {0, 3}


def test_pack_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 1)], "query_id long, rank long, chars long")
    assert [r["rank"] for r in fusion.pack(hits, 10).collect()] == [1]


def test_difference_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, sha string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "doc_id long, sha string")
    d = {r["doc_id"]: r["change"] for r in maintenance.difference(old, new).collect()}
    assert d == {1: "MISSING", 2: "SAME", 3: "UPDATE", 4: "ADD"}
    out = maintenance.upsert(old, new.filter("doc_id > 2"), spark.createDataFrame([(1,)], "doc_id long"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, new.collect()))


def test_order_statistics(spark):
    """Against sorting, with null keys, infinities, NaN, one value, many equal ones and a spread that one bin holds nearly all of."""
    import random

    r, inf = random.Random(4), float("inf")
    groups = {"a": list(range(1, 21)), None: [1.5], "same": [2.0] * 50, "wide": [r.gauss(0, 1) * 10 ** r.randint(-9, 9) for _ in range(501)], "odd": [-inf, -inf, inf, 0.0, float("nan"), 3.0], "huge": [-1e308, 1e308, 0.5]}
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None)]
    out = {x["k"]: x for x in evaluate.order_statistics(spark.createDataFrame(data, "k string, v double").repartition(5), ["k"], "v", evaluate.MEDIAN | evaluate.P95).collect()}
    for k, vs in groups.items():
        s = sorted(map(float, vs), key=lambda v: (v != v, v))
        n = len(s)
        assert out[k]["n"] == n and str([out[k][c] for c in ("low", "high", "p95")]) == str([s[(n + 1) // 2 - 1], s[n // 2], s[-(-95 * n // 100) - 1]]), k


def test_order_statistics_on_skew(spark, monkeypatch):
    """Spreads over tens of powers of ten, two outliers, three in four values equal: less than one value in a hundred is left to be ordered, and ends that
    miss a rank are made good."""
    e = F.exp(F.randn(1) * 10)
    one = spark.range(100_000).select(F.lit("spread").alias("k"), e.alias("v"))
    two = spark.range(100_000).select(F.lit("outliers").alias("k"), F.when(F.col("id") == 0, 1e300).when(F.col("id") == 1, 1e150).otherwise(e).alias("v"))
    tie = spark.range(100_000).select(F.lit("equal").alias("k"), F.when(F.col("id") < 75_000, 1.5).otherwise(F.rand(3)).alias("v"))
    nan = spark.range(100_000).select(F.lit("nan").alias("k"), F.when(F.col("id") < 75_000, float("nan")).otherwise(F.rand(3)).alias("v"))
    df = one.union(two).union(tie).union(nan).cache()
    values = {}
    for k, v in df.collect():
        values.setdefault(k, []).append(v)
    want = {k: [str(s[i]) for i in (49_999, 50_000, 94_999)] for k, vs in values.items() for s in [sorted(vs, key=lambda v: (v != v, v))]}
    keyed = df.select(evaluate._key(["k"]).alias("k"), "v")
    left = evaluate.near(keyed, evaluate.ends(keyed, evaluate.MEDIAN)).groupBy("k", "t").count().collect()
    assert max(r["count"] for r in left) < 1000
    for around in (evaluate.AROUND, -0.01):  # ends the wrong way round hold nothing
        monkeypatch.setattr(evaluate, "AROUND", around)
        got = {r["k"]: [str(r[c]) for c in ("low", "high", "p95")] for r in evaluate.order_statistics(df, ["k"], "v", evaluate.MEDIAN | evaluate.P95).collect()}
        assert got == want
    df.unpersist()


def test_merkle_ignores_partitions(spark):
    df = spark.range(5000).select(F.col("id"), T.sha(F.col("id").cast("string")).alias("h"))
    a = evaluate.merkle(df, "id", "h", 10).first()[0]
    assert a == evaluate.merkle(df.repartition(7), "id", "h", 10).first()[0] != evaluate.merkle(df.filter("id != 17"), "id", "h", 10).first()[0]


def office(kind: str) -> bytes:
    w, a, p = openxml.WORD[1:-1], openxml.DRAWING[1:-1], openxml.SLIDES[1:-1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if kind == "docx":
            par = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
            cell = lambda t: f"<w:tc>{par(t)}</w:tc>"
            z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{par("MARKER-1")}{par(" ")}<w:tbl><w:tr>{cell("a")}{cell("")}{cell("b")}</w:tr></w:tbl>{par("TAIL-1")}</w:body></w:document>')
        else:
            for k in (1, 2, 10):
                z.writestr(f"ppt/slides/slide{k}.xml", f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:sp><p:txBody><a:p><a:r><a:t>slide {k}</a:t></a:r></a:p></p:txBody></p:sp></p:sld>')
    return out.getvalue()


def test_office_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.docx").write_bytes(office("docx"))
    (tmp_path / "b.pptx").write_bytes(office("pptx"))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    rows = {(r["path"].rsplit("/", 1)[1], r["slide"]): r for r in openxml.read(spark, str(tmp_path)).collect()}
    assert rows["a.docx", None]["text"] == "MARKER-1\nTAIL-1\na | b" and rows["a.docx", None]["tables"] == 1
    assert [rows["b.pptx", k]["text"] for k in (1, 2, 3)] == ["slide 1", "slide 2", "slide 10"] and rows["b.pptx", 1]["slides"] == 3
    assert rows["c.docx", None]["error"] == "BadZipFile"


def test_publish_last(spark, tmp_path):
    root = str(tmp_path / "db")
    df = spark.range(3)
    sinks.publish(root, "v1", {"chunks": df, "vectors": df}, {"record_count": 3})
    with pytest.raises(ValueError):
        sinks.publish(root, "v2", {"chunks": df.limit(2)}, {"record_count": 3})
    assert sinks.manifest(spark, root)["version"] == "v1" and sinks.current(spark, root, "chunks").count() == 3
    sinks.write_clean(df, f"{root}/clean")
    sinks.write_bundle(df.withColumn("result_set_id", F.lit("r1")), f"{root}/spool")
    assert spark.read.json(f"{root}/clean").count() == spark.read.json(f"{root}/spool").count() == 3


def test_passages_of_all_documents(spark):
    """Long documents, more than eight with one passage, words cut at a passage's ends, passages without a word inside."""
    p = "alpha beta gamma delta"
    data = [(k, f"x {p} y{k}") for k in range(12)] + [(20, "filler word " * 3000 + p), (21, "delta gamma beta alpha"), (22, "Alpha Beta Gamma Delta"), (23, "xalpha beta gamma deltay"), (24, "a #*# b"), (25, None), (26, "solo")]
    asked = [(1, p), (2, "#*#"), (3, "solo"), (4, "  "), (5, "alpha nowhere delta")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    out = lanes.passages(docs, spark.createDataFrame(asked, "query_id long, text string"))
    want = [(q, d) for q, t in asked if t.strip() for d, x in data if x and t in x]
    assert sorted((r["query_id"], r["doc_id"]) for r in out.collect()) == sorted(want)


def test_exact_lane_is_not_cut_by_bm25(spark, tmp_path):
    from corvane.plans import fusion as plan

    p = "alpha beta gamma delta"
    texts = [p] * 9 + ["filler word " * 3000 + p]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, p)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, [1.0, 0.0], "a")], "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["doc_id"] for r in plan.hits(spark, str(tmp_path)).filter("contains(signals, 'exact')").collect()}
    assert got == set(range(10))


def _bm25(docs, questions, k):
    """One pair at a time."""
    import math
    import re
    from collections import Counter

    ts = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in docs if t is not None}
    average = sum(map(len, ts.values())) / len(ts)
    df = Counter(w for t in ts.values() for w in set(t))
    out = set()
    for q, text in questions:
        scores = []
        for d, t in ts.items():
            tf = Counter(t)
            shared = set(re.findall(r"[^\W_]+", (text or "").lower())) & set(t)
            if shared:
                s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / average)) for w in shared)
                scores.append((-round(s, 6), d))
        out |= {(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_bm25_by_blocks_equals_one_pair_at_a_time(spark, monkeypatch, few):
    """Blocks of few rows and questions, broadcast or not; null and empty texts, ties of copies, terms that no document has."""
    from corvane.operators import blocks

    for name, value in {"ROWS": 3, "ITEMS": 40, "QUESTIONS": 2, "PAIRS": 4, "FEW": few}.items():
        monkeypatch.setattr(blocks, name, value)
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("a b c d e f Gg hh".split(), k=rng.randint(1, 30)))) for i in range(40)] + [(50, None), (51, ""), (52, "a b c"), (53, "a b c"), (54, "...")]
    asked = [(i, " ".join(rng.choices("a b c gg zz".split(), k=3))) for i in range(7)] + [(8, None), (9, "zz"), (10, "a b c a")]
    out = lanes.lexical(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string"), 5)
    assert {tuple(r) for r in out.collect()} == _bm25(docs, asked, 5)


def test_lanes_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert lanes.lexical(none, some).count() == 0
    assert lanes.lexical(some.withColumnRenamed("query_id", "doc_id"), none.withColumnRenamed("doc_id", "query_id")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lanes.dense(vectors, vectors.withColumnRenamed("vec_id", "query_id")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_dense_by_blocks_equals_one_pair_at_a_time(spark, monkeypatch, few):
    """Null, zero and non-finite vectors, null components and other lengths answer nothing; copies are ties."""
    from corvane.operators import blocks

    for name, value in {"ROWS": 4, "ITEMS": 30, "QUESTIONS": 2, "FEW": few}.items():
        monkeypatch.setattr(blocks, name, value)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(30)]
    rows += [(31, rows[0][1]), (32, [0.0, 0.0, 0.0]), (33, None), (34, [1.0, None, 0.0]), (35, [1.0, float("nan"), 0.0]), (36, [1.0, float("inf"), 0.0]), (37, [1.0, 2.0]), (38, []), (39, [2.0, 4.0])]
    right = {i: v for i, v in rows if v and None not in v and all(map(math.isfinite, v)) and any(v)}
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)
    expected = set()
    for q in [i for i in right if i % 3 == 0 or i > 30]:
        near = sorted((-cosine(right[q], v), i) for i, v in right.items() if i != q and len(v) == len(right[q]))
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(near[:4])}
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = lanes.dense(v, v.filter("vec_id % 3 = 0 or vec_id > 30").withColumnRenamed("vec_id", "query_id"), 4)
    assert {tuple(r) for r in out.collect()} == expected


def test_casefold_of_all_letters(spark):
    """Every code point, alone, among others and in runs, folds as Python's casefold has it."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    data = [("".join(points[k : k + 64]),) for k in range(0, len(points), 64)] + [("Straße ΣΑΣ",), ("",), (None,), ("İıſK",)]
    df = spark.createDataFrame(data, "t string").repartition(4)
    assert all(r["f"] == (None if r["t"] is None else r["t"].casefold()) for r in df.select("t", T.casefold(F.col("t")).alias("f")).collect())


def test_list_distance(spark):
    """Equal lists, lists of no common document, one list missing, a swap at the top that weighs more than one at the end; against the sums by depth."""
    frame = lambda lists: spark.createDataFrame([(q, r + 1, d) for q, ds in lists.items() for r, d in enumerate(ds)], "query_id long, rank long, doc_id long")
    a = {1: [1, 2, 3, 4], 2: [1, 2, 3, 4], 3: [1, 2, 3, 4], 4: [1, 2, 3, 4], 5: [1, 2], 6: [1, 2, 3], 7: [9]}
    b = {1: [1, 2, 3, 4], 2: [2, 1, 3, 4], 3: [1, 2, 4, 3], 4: [5, 6, 7, 8], 6: [3, 7, 1, 8, 9], 7: [9], 8: [1]}
    got = {r["query_id"]: r for r in evaluate.list_distance(frame(a), frame(b), 8).collect()}

    def rbo(x, y, p=0.9):
        n = max(len(x), len(y))
        share = [len(set(x[:d]) & set(y[:d])) / d for d in range(1, n + 1)]
        return round((1 - p) / p * sum(s * p**d for d, s in enumerate(share, 1)) + share[-1] * p**n, 6)

    assert set(got) == set(range(1, 9)) and all(abs(got[q]["rbo"] - rbo(a.get(q, []), b.get(q, []))) < 2e-6 for q in got)
    assert (got[1]["rbo"], got[1]["footrule"], got[1]["equal"]) == (1.0, 0.0, True) and (got[4]["rbo"], got[4]["footrule"], got[4]["common"]) == (0.0, 1.0, 0)
    assert got[2]["rbo"] < got[3]["rbo"] < 1 and got[2]["footrule"] == got[3]["footrule"] and not got[5]["equal"]


def test_locators_leave_nothing(spark):
    """Drive, network and home paths, with blanks too, in and out of quotes; what stands around them stays."""
    from corvane.plans import protocol

    cases = {
        r"a \\server\share\secret.txt b": "a [locator] b", "x /Users/anna/notes.md y": "x[locator] y", "path /opt/data/x too": "path[locator] too", r"of C:\Program Files\x\y.txt all": "of [locator] all",
        r'"C:\My Documents\a b.txt", next': "[locator], next", 'in "/home/a user/b c.txt" end': "in [locator] end", r"C:\a and then D:\b end": "[locator] and then [locator] end", "50/50 and/or 3:1 a\\b": "50/50 and/or 3:1 a\\b",
        'summary_file: "D:\\a b\\c.txt", 7': "[locator], 7", "FILE:///x/y z": "[locator] z",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "text string, want string")
    got = df.select("text", "want", protocol.redact_locators(F.col("text")).alias("got"), protocol.shows_locators(protocol.redact_locators(F.col("text"))).alias("shows")).collect()
    assert [(r["text"], r["got"]) for r in got] == [(r["text"], r["want"]) for r in got] and not any(r["shows"] for r in got)


def test_pointer_bounds_come_first(spark):
    from corvane.plans import protocol

    name = "01234567-89ab-cdef-0123-456789abcdef"
    pointer = lambda n: f'{{"status":"written","result_set_id":"{name}","summary_file":"/spool/{name}/summary.json","bytes":{n}}}'
    summary = f'{{"schema_version":"v1","result_set_id":"{name}","selected_db":"a-rag"}}'
    rows = spark.createDataFrame([(pointer(2), summary, 1), (pointer(100), summary, 99), (pointer(99), summary, 99), (pointer(3 << 20), summary, 3 << 20)], "p string, s string, n long")
    code = protocol.check_pointer(F.parse_json("p"), F.parse_json("s"), F.col("n"), F.lit("/spool"), F.lit("a-rag"))
    assert [r[0] for r in rows.select(code).collect()] == ["invalid_search_summary", "invalid_search_pointer", "ok", "invalid_search_summary"]


def test_views_stop_at_the_cap(spark):
    """What a search is asked for: no view of a chat that has enough, and no turn once all chats have."""
    views = spark.createDataFrame([(c, 10 * c + k) for c in (1, 2, 3) for k in range(4)], "chat long, query_id long")
    answers = {10: [1, 2, 3], 11: [3, 4], 12: [9], 20: [1], 21: [1], 22: [1], 23: [5], 30: [7, 8, 9, 10]}
    table = spark.createDataFrame([(q, d) for q, ds in answers.items() for d in ds], "query_id long, doc_id long")
    asked = []

    def search(due):
        asked.append(sorted(r["query_id"] for r in due.collect()))
        return table.join(due.select("query_id"), "query_id", "left_semi")

    got = {(r["query_id"], r["new_docs"]) for r in fusion.views_until(views, search, 4).collect()}
    assert asked == [[10, 20, 30], [11, 21], [22], [23]] and got == {(10, 3), (20, 1), (30, 4), (11, 1), (21, 0), (22, 0), (23, 1)}
    assert fusion.views_until(views.limit(0), search, 4).count() == 0 and len(asked) == 4


def test_casefold_of_plain_texts_is_lower(spark):
    """Texts of common alphabets have a way of their own, and it is the same folding."""
    texts = ["Größe ÀÉ 你好 ДА ΑΒ", "ΣΑΣ", "İ", "straſse", "ŉ", "plain", "ẞ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.casefold(F.col("t")).alias("f"), (~F.col("t").rlike(T._not_plain())).alias("plain"))
    out = df.collect()
    assert all(r["f"] == (None if r["t"] is None else r["t"].casefold()) for r in out)
    assert [r["plain"] for r in out] == [True, False, False, False, False, True, False, None]
