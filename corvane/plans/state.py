"""M8: stateful behaviour in batch form, and the same as streams that run to their end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane import streaming
from corvane.plans.base import query
from corvane.sources import files
from corvane.sources.tables import table
from corvane.sources.work import folder
from corvane.streaming import stateful


TOKENS = """WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age, max(ts) OVER (PARTITION BY user_id) AS now FROM events WHERE event_type = 'click')
SELECT user_id, event_id, age <= 2 AS held, age <= 2 AND ts > now - INTERVAL 6 HOUR AS live FROM r"""


@query(TOKENS)
def token_registry_batch(spark, sf_dir):
    """Result tokens of each user: the two latest are held, and live for six hours."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    e = table(spark, sf_dir, "events").filter("event_type = 'click'").select("user_id", "event_id", "ts", F.row_number().over(w).alias("age"), F.max("ts").over(Window.partitionBy("user_id")).alias("now"))
    return e.select("user_id", "event_id", (F.col("age") <= 2).alias("held"), ((F.col("age") <= 2) & (F.col("ts") > F.col("now") - F.expr("INTERVAL 6 HOURS"))).alias("live"))


LIVES = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, count(DISTINCT session) AS sessions, count(*) AS events FROM s GROUP BY user_id"""


@query(LIVES)
def idle_sessions(spark, sf_dir):
    """A daemon that ends after three idle hours: one life is one session."""
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    s = e.groupBy("user_id", F.session_window("ts", "3 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def warn_once(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT event_type AS phase, count(*) AS calls, round(sum(value), 4) AS seconds FROM events GROUP BY event_type")
def stream_phase_totals(spark, sf_dir):
    return streaming.phase_totals(spark, sf_dir)


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'invalid_json' WHEN event_id % 11 = 0 THEN 'too_large' ELSE 'ok' END AS code FROM events")
def stream_requests(spark, sf_dir):
    return streaming.requests(spark, sf_dir)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def stream_warn_once(spark, sf_dir):
    return streaming.warn_once(spark, sf_dir)


@query(TOKENS)
def stream_tokens(spark, sf_dir):
    """The registry as keyed state: a new token evicts the third, and ends what is six hours older."""
    clicks = streaming.events(spark, sf_dir).filter("event_type = 'click'")
    return stateful.tokens(clicks, folder(spark, "streams/tokens"))


@query(LIVES)
def stream_lives(spark, sf_dir):
    """The daemon's lives as keyed state with timers."""
    return stateful.lives(streaming.events(spark, sf_dir), folder(spark, "streams/lives"))


LINES = """WITH l AS (SELECT props AS line FROM events UNION ALL SELECT unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL)
SELECT code, count(*) AS n, sum(strlen(line))::BIGINT AS bytes FROM (SELECT line, CASE WHEN strlen(line) >= 1048576 OR NOT json_valid(line) OR trim(line) = '' THEN 'parse_error' WHEN json_type(line) = 'OBJECT' THEN 'ok' ELSE 'invalid_request' END AS code FROM l) GROUP BY code"""


def landed(spark, sf_dir) -> str:
    """A folder of lines as they might come in: the events' requests, and all lines of the documents, which are none."""
    root = folder(spark, "landing")
    table(spark, sf_dir, "events").select("props").write.text(f"{root}/events")
    table(spark, sf_dir, "documents").select("text").filter("text IS NOT NULL").write.text(f"{root}/documents")
    return root


@query(LINES)
def request_lines(spark, sf_dir):
    """Stored lines by what they are, files split like other texts."""
    rows = files.requests(spark, landed(spark, sf_dir))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(LINES)
def stream_request_lines(spark, sf_dir):
    """The same lines as a stream of their files."""
    rows = streaming.request_lines(spark, landed(spark, sf_dir), folder(spark, "streams/lines"))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
