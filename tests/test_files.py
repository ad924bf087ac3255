"""Sources and sinks on files: texts, sections, request lines, stored collections, bundles, resumed streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corvane.sources import files, sinks


def test_texts_and_sections(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("before\r\n# One\r\nfirst\r\n\r\nmore\r\n## Two\r\n# \r\n\r\n".encode())
    (tmp_path / "sub/b.TXT").write_text("plain ÄÖ")
    (tmp_path / "c.puml").write_bytes(b"\xff\xfe")
    (tmp_path / "d.exe").write_bytes(b"x")
    out = {r["path"].rsplit("/", 1)[1]: r for r in files.texts(spark, str(tmp_path)).collect()}
    assert set(out) == {"a.md", "b.TXT", "c.puml"} and out["b.TXT"]["text"] == "plain ÄÖ" and (out["c.puml"]["text"], out["c.puml"]["error"]) == (None, "not_utf8")
    assert files.listed(spark, str(tmp_path), recursive=False).count() == 2
    found = files.markdown_sections(files.texts(spark, str(tmp_path), (".md",))).orderBy("place").collect()
    assert [(r["title"], r["text"]) for r in found] == [("", "before"), ("One", "first\n\nmore"), ("Two", "")]


def test_request_lines(spark, tmp_path):
    lines = [b'{"b":1,"a":"\xc3\xa4"}', b"[1]", b"{", b'"\xff"', b'{"x":"' + b"y" * (files.MAX_LINE - 9) + b'"}', b'{"x":"' + b"y" * (files.MAX_LINE - 8) + b'"}', b"", b'{"z":1}']
    (tmp_path / "r.jsonl").write_bytes(b"\n".join(lines))
    out = files.requests(spark, str(tmp_path)).orderBy("line").collect()
    assert [r["code"] for r in out] == ["ok", "invalid_request", "parse_error", "parse_error", "ok", "parse_error", "parse_error", "parse_error"] and out[0]["request"] == '{"a":"ä","b":1}'
    (tmp_path / "r.jsonl").write_bytes(b"\n".join(lines[:1]) + b"\n")
    assert [r["code"] for r in files.requests(spark, str(tmp_path)).collect()] == ["ok"]


def test_one_file_in_several_tasks(spark, tmp_path):
    """Lines keep their numbers when a file is split inside, lines lie across the cuts and one is longer than a split."""
    lines = ['{"n":%d,"x":"%s"}' % (k, "y" * (k % 300)) for k in range(3000)] + ['{"z":"' + "w" * 200_000 + '"}', "7", "no"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('{"n":-1}\n{"n":-2}')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        out = files.requests(spark, str(tmp_path)).orderBy("path", "line").collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    mine, other = [r for r in out if r["path"].endswith("a.jsonl")], [r for r in out if r["path"].endswith("b.jsonl")]
    assert [r["line"] for r in mine] == list(range(3003)) and [json.loads(r["request"])["n"] for r in mine[:3000]] == list(range(3000))
    assert [r["code"] for r in mine[3000:]] == ["ok", "invalid_request", "parse_error"] and [r["code"] for r in other] == ["ok", "parse_error"]


def test_request_lines_as_a_stream(spark, tmp_path):
    """Files that come between two runs are read by the second, none is read twice."""
    from corvane import streaming

    root, path = tmp_path / "in", str(tmp_path / "job")
    root.mkdir()
    (root / "1.jsonl").write_text('{"a":1}\nx\n')
    count = lambda: {r["code"]: r["count"] for r in streaming.request_lines(spark, str(root), path).groupBy("code").count().collect()}
    assert count() == {"ok": 1, "parse_error": 1}
    (root / "2.jsonl").write_text('[2]\n{"a":2}\n')
    assert count() == {"ok": 2, "parse_error": 1, "invalid_request": 1} == count()


def test_reports_and_delivery(spark, tmp_path):
    for _ in range(2):
        sinks.write_report(spark, str(tmp_path / "r.json"), {"b": "ä", "a": [1]})
    assert (tmp_path / "r.json").read_text() == '{\n  "b": "ä",\n  "a": [\n    1\n  ]\n}\n'
    rows = spark.createDataFrame([("E1", 7, "said")], "label string, doc_id long, excerpt string")
    assert [sinks.deliver(rows, "stdout", k).first()[0] for k in ("json", "prompt", "text")] == ['{"label":"E1","doc_id":7,"excerpt":"said"}', "[E1] (7) said", "said"]
    sinks.deliver(rows, "file", "json", str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["doc_id"] == 7
    with pytest.raises(ValueError):
        sinks.deliver(rows, "mail", "json")
    for _ in range(2):
        sinks.append_events(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """A second run on the same checkpoint reads what is new, and nothing twice; a failed batch is done again."""
    from corvane import streaming

    source, path = str(tmp_path / "in"), str(tmp_path / "job")
    one = lambda a, b: spark.range(a, b).coalesce(1).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema("id long").parquet(source)
    one(0, 10)
    streaming.to_end(read(), path)
    one(10, 15)

    def fails(df, batch):
        raise RuntimeError("stopped")

    with pytest.raises(Exception):
        streaming.to_end(read(), path, fails)
    streaming.to_end(read(), path)
    streaming.to_end(read(), path)
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/out").collect()) == list(range(15))


def test_a_line_with_more_than_one_value_is_no_request(spark, tmp_path):
    """What follows a JSON value on its line makes the line a parse error, however it is quoted or bracketed."""
    lines = ["4763047826333361 Of thnd", '{"a":1} x', '{"a":1} {"b":2}', "1,2", "1],[2", '1,"x"]', '"a" "b"', "null x", ' {"a":[1,"]"]} ', "[1, 2]", '"a,b"', "null"]
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + "\n")
    out = files.requests(spark, str(tmp_path)).orderBy("line").collect()
    assert [r["code"] for r in out] == ["parse_error"] * 8 + ["ok"] + ["invalid_request"] * 3
    assert [r["request"] for r in out[8:]] == ['{"a":[1,"]"]}', "[1,2]", '"a,b"', "null"] and not any(r["request"] for r in out[:8])


def test_many_lines_over_the_limit(spark, tmp_path):
    """2,000 lines of a megabyte: padded blank by blank and parsed whole they took about 20 ms each on one core, in one task."""
    import time

    from corvane import streaming

    rows = spark.range(2000).select((F.col("id") * 11).alias("event_id"), F.lit('{"k": 1}').alias("props"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    began = time.monotonic()
    out = {r["code"]: r["count"] for r in streaming.requests(spark, str(tmp_path)).groupBy("code").count().collect()}
    assert out == {"invalid_json": 223, "too_large": 1777} and time.monotonic() - began < 20
