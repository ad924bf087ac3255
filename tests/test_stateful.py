"""Keyed state over two runs of one checkpoint folder, late rows between, against the batch forms of the same rows."""

from __future__ import annotations

import datetime
import random

from compare import duck_rows, spark_rows

from corvane.plans import state
from corvane.streaming import stateful

BASE = datetime.datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, ts timestamp, event_type string"


def hours(r, n, first, a, b):
    return [(r.randint(0, 4), first + k, BASE + datetime.timedelta(minutes=15 * r.randint(a, b)), r.choice(["click", "view"])) for k in range(n)]


def test_two_runs(spark, tmp_path):
    """The second run brings newer rows, rows that are older than all that is held, and rows that join two lives into one."""
    r = random.Random(8)
    runs = [hours(r, 60, 0, 0, 150), hours(r, 40, 100, 100, 260) + hours(r, 20, 200, 0, 150), hours(r, 30, 300, 260, 900)]
    tokens, lives = str(tmp_path / "tokens"), str(tmp_path / "lives")
    for k in range(3):
        spark.createDataFrame(runs[k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = [x for run in runs[: k + 1] for x in run]
        (tmp_path / f"sql{k}").mkdir()
        for name in "region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations".split():
            (tmp_path / f"sql{k}" / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).toPandas().to_parquet(tmp_path / f"sql{k}" / "events.parquet")
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        got = stateful.tokens(stream.filter("event_type = 'click'"), tokens)
        assert spark_rows(got) == duck_rows(state.TOKENS, str(tmp_path / f"sql{k}"))
        got = stateful.lives(stream, lives, "10 days")
        assert spark_rows(got) == duck_rows(state.LIVES, str(tmp_path / f"sql{k}"))


def test_lives_end_by_the_watermark(spark, tmp_path):
    """A timer counts and forgets what no event can join any more, and later rows of that time are not waited for."""
    at = lambda h: BASE + datetime.timedelta(hours=h)
    path, source = str(tmp_path / "lives"), str(tmp_path / "in")
    add = lambda *hs: spark.createDataFrame([(1, i, at(h), "view") for i, h in enumerate(hs)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: {x["user_id"]: (x["sessions"], x["events"]) for x in stateful.lives(spark.readStream.schema(SCHEMA).parquet(source), path, "1 hour").collect()}
    add(0, 1, 2, 20)
    assert run() == {1: (2, 4)}
    add(3, 21)  # 3 is older than the watermark of 19
    assert run() == {1: (2, 5)}
    add(40, 41)
    assert run() == {1: (3, 7)}


def test_lives_of_many_users_in_any_time_zone(spark, tmp_path):
    """Users of several groups, and timers by the same clock as the rows: a life that can still go on is not ended early west of Greenwich."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        at = lambda h: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=h)
        path, source = str(tmp_path / "lives"), str(tmp_path / "in")
        users = [0, 1, 63, 64, 1000]
        for hours_, n in (((10, 12), 2), ((14, 30), 4)):
            spark.createDataFrame([(u, i, at(h), "view") for u in users for i, h in enumerate(hours_)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
            got = {x["user_id"]: (x["sessions"], x["events"]) for x in stateful.lives(spark.readStream.schema(SCHEMA).parquet(source), path, "1 hour").collect()}
            assert got == dict.fromkeys(users, (n // 2, n))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
