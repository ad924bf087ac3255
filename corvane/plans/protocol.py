"""M9: the request protocol: JSON arguments, registry items, result pointers, lifecycle, tokens, routing and delivery."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.base import query
from corvane.plans.surface import MAX_COUNT, MAX_QUESTION
from corvane.sources import files
from corvane.sources.tables import table

#: Fixed values of the contract.
ARGUMENTS = ("question", "database")
TEXT_KEYS = ("title", "query_hint", "content_summary")
SUMMARY_BYTES = (2, 2 << 20)


def json_type(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, ... of a variant; null if there is none."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def member(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def text_of(value: Column, key: str) -> Column:
    """A member that is a string; numbers and booleans are not taken for one."""
    inner = member(value, key)
    return F.when(json_type(inner) == "STRING", F.try_variant_get(inner, "$", "string"))


def count_of(value: Column, key: str) -> Column:
    """A member that is a whole number from 0 to MAX_COUNT; booleans are no numbers."""
    inner = member(value, key)
    n = F.when(json_type(inner) == "BIGINT", F.try_variant_get(inner, "$", "bigint"))
    return F.when(n.between(0, MAX_COUNT), n)


def validate_json(line: Column) -> Column:
    """The first rule that a request's JSON arguments break."""
    value = files.parsed(line)
    unknown = F.size(F.array_except(F.json_object_keys(line), F.array(*[F.lit(k) for k in ARGUMENTS]))) > 0
    question, database = text_of(value, "question"), text_of(value, "database")
    given = F.coalesce(~json_type(member(value, "database")).isin("VOID"), F.lit(False))
    return (
        F.when(value.isNull(), "invalid_json").when(json_type(value) != "OBJECT", "not_an_object").when(unknown, "unknown_argument").when(question.isNull(), "question_not_a_string")
        .when(T.blank(question), "question_blank").when(F.length(question) > MAX_QUESTION, "question_too_long").when(F.contains(question, F.lit("\0")), "question_nul")
        .when(given & ~F.coalesce(database.rlike(T.DB_NAME), F.lit(False)), "database_invalid").otherwise("ok")
    )


REQUESTS = ('["q"]', '{"question":"q","debug":1}', '{"question":7}', '{"question":" \\n"}', '{"database":"a-rag"}', '{"question":"q","database":5}', '{"question":"q","database":"x-rag"}', '{"question"', '{"question":"q","database":"-rag"}', '{"question":"q","database":null}', '{"question":true}', '{"question":"a\\u0000b"}')
_CASES = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(REQUESTS))


@query(rf"""WITH r AS (SELECT conv_id, turn, CASE (conv_id + turn) % {len(REQUESTS)} {_CASES} END AS line FROM conversations),
p AS (SELECT *, CASE WHEN json_valid(line) THEN json_type(line) END AS t, CASE WHEN json_valid(line) AND json_type(line) = 'OBJECT' THEN json_keys(line) ELSE [] END AS ks,
CASE WHEN json_valid(line) THEN json_type(line, '$.question') END AS qt, CASE WHEN json_valid(line) THEN line ->> '$.question' END AS q, CASE WHEN json_valid(line) THEN json_type(line, '$.database') END AS dt, CASE WHEN json_valid(line) THEN line ->> '$.database' END AS db FROM r)
SELECT conv_id, turn, CASE WHEN t IS NULL THEN 'invalid_json' WHEN t <> 'OBJECT' THEN 'not_an_object' WHEN len(list_filter(ks, lambda k: k NOT IN ('question', 'database'))) > 0 THEN 'unknown_argument'
WHEN coalesce(qt, '') <> 'VARCHAR' THEN 'question_not_a_string' WHEN regexp_matches(q, '^\s*$') THEN 'question_blank' WHEN length(q) > 16000 THEN 'question_too_long' WHEN contains(line, '\u0000') THEN 'question_nul'
WHEN dt IS NOT NULL AND dt <> 'NULL' AND (dt <> 'VARCHAR' OR NOT regexp_full_match(db, '[A-Za-z0-9][A-Za-z0-9_.-]*-rag')) THEN 'database_invalid' ELSE 'ok' END AS code FROM p""")
def request_json(spark, sf_dir):
    k = ((F.col("conv_id") + F.col("turn")) % len(REQUESTS)).cast("int")
    line = F.element_at(F.array(*[F.lit(x) for x in REQUESTS]), k + 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", validate_json(line).alias("code"))


ITEM = """'{"name":"' || source || '-rag","title":' || CASE n % 3 WHEN 0 THEN '"T"' WHEN 1 THEN '7' ELSE 'true' END || ',"query_hint":"H ' || n || '","content_summary":null,"secret":"x","source_count":' || CASE n % 4 WHEN 0 THEN 'true' WHEN 1 THEN '1000001' WHEN 2 THEN '-1' ELSE n::VARCHAR END || ',"source_types":[' || CASE WHEN n % 6 = 0 THEN '' ELSE '{"type":"n","count":' || n::VARCHAR || '},' END || '__TYPES__' || ']}'"""
#: More than 20, some of them no objects, with members of other types or counts out of range, or with nothing to keep.
_TYPES = ",".join("7" if k % 5 == 0 else '{"type":3,"label":null,"x":"y"}' if k % 7 == 0 else f'{{"type":"t{k}","label":"L {k}","count":{["true", "-1", "1000001", "1.5", str(k)][k % 5]}}}' if k % 2 else f'{{"label":"L {k}","count":{k}}}' for k in range(1, 27))
ITEM = ITEM.replace("__TYPES__", _TYPES)
TYPES = 20


@query(f"""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), i AS (SELECT source, {ITEM} AS item FROM g),
k AS (SELECT *, CASE WHEN json_type(item, '$.source_count') IN ('UBIGINT', 'BIGINT') THEN (item ->> '$.source_count')::BIGINT END AS c FROM i)
SELECT item ->> '$.name' AS name, CASE WHEN json_type(item, '$.title') = 'VARCHAR' THEN item ->> '$.title' END AS title, CASE WHEN json_type(item, '$.query_hint') = 'VARCHAR' THEN item ->> '$.query_hint' END AS query_hint,
CASE WHEN json_type(item, '$.content_summary') = 'VARCHAR' THEN item ->> '$.content_summary' END AS content_summary, CASE WHEN c BETWEEN 0 AND 1000000 THEN c END AS source_count,
array_to_string(list_transform(list_filter(list_transform((item::JSON -> '$.source_types[*]')[1:20], lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN [CASE WHEN json_type(x, '$.type') = 'VARCHAR' THEN x ->> '$.type' END, CASE WHEN json_type(x, '$.label') = 'VARCHAR' THEN x ->> '$.label' END, CASE WHEN json_type(x, '$.count') IN ('UBIGINT', 'BIGINT') AND (x ->> '$.count')::BIGINT BETWEEN 0 AND 1000000 THEN x ->> '$.count' END] END), lambda t: t[1] IS NOT NULL OR t[2] IS NOT NULL OR t[3] IS NOT NULL), lambda t: coalesce(t[1], '-') || '|' || coalesce(t[2], '-') || '|' || coalesce(t[3], '-')), ';') AS source_types FROM k""")
def registry_projection(spark, sf_dir):
    """Items of a registry as JSON: allow-listed strings stay, counts in range that are no booleans, of the first 20 source types those with
    anything left, nothing else."""
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    item = F.parse_json(F.expr(ITEM.replace("n::VARCHAR", "cast(n AS string)")))
    return g.select(text_of(item, "name").alias("name"), *[text_of(item, k).alias(k) for k in TEXT_KEYS], count_of(item, "source_count").alias("source_count"), source_types(item).alias("source_types"))


def source_types(item: Column) -> Column:
    """The first TYPES of an item's source types, as type|label|count of what may be shown of each, in order; those of which nothing may are left out."""
    each = F.slice(F.coalesce(F.try_variant_get(item, "$.source_types", "array<variant>"), F.array().cast("array<variant>")), 1, TYPES)
    shown = lambda x: F.struct(text_of(x, "type").alias("type"), text_of(x, "label").alias("label"), count_of(x, "count").cast("string").alias("count"))
    kept = F.filter(F.transform(each, shown), lambda t: t["type"].isNotNull() | t["label"].isNotNull() | t["count"].isNotNull())
    return F.array_join(F.transform(kept, lambda t: F.concat_ws("|", *[F.coalesce(t[c], F.lit("-")) for c in ("type", "label", "count")])), ";")


POINTER = """'{"status":"' || CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'written' END || '","result_set_id":"' || CASE WHEN doc_id % 7 = 0 THEN upper(id) ELSE id END || '","summary_file":"/spool/' || id || CASE WHEN doc_id % 13 = 0 THEN '/../summary.json' ELSE '/summary.json' END || '","bytes":' || (n + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) || '}'"""
SUMMARY = """'{"schema_version":"' || CASE WHEN doc_id % 17 = 0 THEN 'v0' ELSE 'v1' END || '","result_set_id":"' || id || '","selected_db":"' || CASE WHEN doc_id % 19 = 0 THEN 'other' ELSE source END || '-rag"}'"""
_ID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


@query(f"""WITH i AS (SELECT doc_id, source, {_ID} AS id FROM (SELECT doc_id, source, md5(text) AS h FROM documents)), s AS (SELECT *, {SUMMARY} AS summary FROM i), b AS (SELECT *, strlen(summary) AS n FROM s), p AS (SELECT *, {POINTER} AS pointer FROM b)
SELECT doc_id, CASE WHEN pointer ->> '$.status' <> 'written' OR NOT regexp_full_match(pointer ->> '$.result_set_id', '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') OR pointer ->> '$.summary_file' <> '/spool/' || (pointer ->> '$.result_set_id') || '/summary.json'
THEN 'invalid_search_pointer' WHEN n < 2 OR n > 2097152 THEN 'invalid_search_summary' WHEN (pointer ->> '$.bytes')::BIGINT <> n THEN 'invalid_search_pointer' WHEN summary ->> '$.schema_version' <> 'v1' OR summary ->> '$.result_set_id' <> pointer ->> '$.result_set_id' OR summary ->> '$.selected_db' <> source || '-rag' THEN 'invalid_search_summary' ELSE 'ok' END AS code FROM p""")
def pointer_check(spark, sf_dir):
    """A search's pointer against the summary that it names: status, canonical id, exact path, recorded size, then schema, id and database."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("h")).withColumn("id", F.expr(_ID))
    d = d.withColumn("summary", F.expr(SUMMARY)).withColumn("n", F.octet_length("summary").cast("long")).withColumn("pointer", F.expr(POINTER))
    return d.select("doc_id", check_pointer(F.parse_json("pointer"), F.parse_json("summary"), F.col("n"), F.lit("/spool"), F.concat("source", F.lit("-rag"))).alias("code"))


def check_pointer(pointer: Column, summary: Column, size: Column, spool: Column, database: Column) -> Column:
    named = text_of(pointer, "result_set_id")
    recorded = F.when(json_type(member(pointer, "bytes")) == "BIGINT", F.try_variant_get(pointer, "$.bytes", "bigint"))
    good = (text_of(pointer, "status") == "written") & named.rlike(T.UUID) & (text_of(pointer, "summary_file") == F.concat(spool, F.lit("/"), named, F.lit("/summary.json")))
    whole = (text_of(summary, "schema_version") == "v1") & (text_of(summary, "result_set_id") == named) & (text_of(summary, "selected_db") == database)
    no = F.lit(False)
    # The bounds of the size come before the size that the pointer has recorded.
    short = F.when(~F.coalesce(good, no), "invalid_search_pointer").when(~F.coalesce(size.between(*SUMMARY_BYTES), no), "invalid_search_summary")
    return short.when(~F.coalesce(recorded == size, no), "invalid_search_pointer").when(~F.coalesce(whole, no), "invalid_search_summary").otherwise("ok")


#: What a result must not show, whatever its case; values that follow a key or a scheme up to white space or a quote go with it. A path in quotes goes up
#: to the quote; one with backslashes goes on after a blank as long as a backslash follows within four words.
_WORDS = r"""(?:(?:[ \t]+[^\s"\\:]+){0,3}[ \t]+[^\s"\\:]+\\[^\s"]*)*"""
_ROOTS = r"(?:home|root|tmp|var|mnt|spool|users|opt|srv|etc|usr|data|private|volumes)"
LOCATORS = rf"""(?i)file://[^\s"]*|"(?:[A-Z]:\\|\\\\|/{_ROOTS}/)[^"]*"|\b(?:summary_file|detail_file|result_set_id|source_path)\b(?:\s*[=:]\s*(?:"[^"]*"|[^\s"]*))?|\b[A-Z]:\\[^\s"]*{_WORDS}|\\\\[^\s"\\]+\\[^\s"]*{_WORDS}|(?:^|[\s"=(])/{_ROOTS}/[^\s"]*"""
FORBIDDEN = ("file://", "summary_file", "detail_file", "result_set_id", "source_path", ":\\", "\\\\", "/home/", "/spool/", "/users/", "/opt/")
_PLANT = [
    " see FILE:///C:/private/a.txt end", " summary_file=C:\\private\\s.json.", " at C:\\private\\routing.json now", " in /home/user/notes.md today", " Result_Set_Id: 12-34", " nothing here",
    " from \\\\server\\share\\secret.txt again", " in /Users/anna/notes.md", " path /opt/data/x too", " of C:\\Program Files\\My Big App\\y.txt all", ' of "/home/a user/b c.txt" all', ' source_path: "D:\\a b\\c d.txt", next',
]
_PLANTED = f"CASE doc_id % {len(_PLANT)} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_PLANT)) + " END"


@query(f"""WITH r AS (SELECT doc_id, text || {_PLANTED} AS text FROM documents), c AS (SELECT doc_id, text, regexp_replace(text, '{LOCATORS}', '[locator]', 'g') AS clean FROM r)
SELECT doc_id, sha256(clean) AS sha, clean <> text AS changed, NOT ({' OR '.join(f"contains(lower(clean), '{x}')" for x in FORBIDDEN)}) AS passes FROM c""")
def locator_redaction(spark, sf_dir):
    """Whole texts, with a locator of some kind at their end."""
    planted = F.element_at(F.array(*[F.lit(x) for x in _PLANT]), (F.col("doc_id") % len(_PLANT) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", planted).alias("text"))
    clean = redact_locators(F.col("text"))
    return d.select("doc_id", T.sha(clean).alias("sha"), (clean != F.col("text")).alias("changed"), (~shows_locators(clean)).alias("passes"))


def redact_locators(c: Column) -> Column:
    return F.regexp_replace(c, LOCATORS, "[locator]")


def shows_locators(c: Column) -> Column:
    """The condition that must not hold of a result."""
    found = F.lit(False)
    for x in FORBIDDEN:
        found = found | F.contains(F.lower(c), F.lit(x))
    return found


_METHOD = "CASE WHEN event_type = 'login' OR event_id % 23 = 0 THEN 'initialize' WHEN event_id % 5 = 0 THEN 'notifications/initialized' WHEN event_id % 7 = 0 THEN 'notifications/cancelled' WHEN event_id % 11 = 0 THEN 'resources/list' WHEN event_id % 2 = 0 THEN 'ping' ELSE 'tools/call' END"


@query(f"""WITH m AS (SELECT user_id, event_id, ts, {_METHOD} AS method FROM events),
s AS (SELECT *, last_value(CASE method WHEN 'initialize' THEN 0 WHEN 'notifications/initialized' THEN 1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ready FROM m)
SELECT event_id, CASE WHEN starts_with(method, 'notifications/') THEN 'no_reply' WHEN method = 'initialize' THEN 'initialized' WHEN coalesce(ready, 0) = 0 THEN 'not_initialized' WHEN method IN ('ping', 'tools/list', 'tools/call') THEN 'ok' ELSE 'method_not_found' END AS reply FROM s""")
def lifecycle(spark, sf_dir):
    """A session is ready from its initialized notification on, until it is initialized again; what comes before gets an error."""
    m = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr(_METHOD).alias("method"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    method = F.col("method")
    ready = F.last(F.when(method == "initialize", 0).when(method == "notifications/initialized", 1), ignorenulls=True).over(w)
    reply = (
        F.when(method.startswith("notifications/"), "no_reply").when(method == "initialize", "initialized").when(F.coalesce(F.col("ready"), F.lit(0)) == 0, "not_initialized")
        .when(method.isin("ping", "tools/list", "tools/call"), "ok").otherwise("method_not_found")
    )
    return m.withColumn("ready", ready).select("event_id", reply.alias("reply"))


@query("""WITH t AS (SELECT user_id, event_id, ts::DATE AS generation, sha256(user_id || '|' || ts::DATE || '|' || event_id) AS token FROM events),
a AS (SELECT user_id, count(*) AS issued, count(DISTINCT token) AS tokens, max(generation) AS now FROM t GROUP BY user_id)
SELECT user_id, issued, issued = tokens AS never_reused, (SELECT count(*) FROM t WHERE t.user_id = a.user_id AND t.generation < a.now) AS stale FROM a""")
def token_generations(spark, sf_dir):
    """Tokens name their generation, a day of the daemon: none is issued twice, and those of an earlier generation are stale."""
    day = F.col("ts").cast("date")
    e = table(spark, sf_dir, "events").select("user_id", day.alias("generation"), T.sha(F.concat_ws("|", F.col("user_id").cast("string"), day.cast("string"), F.col("event_id").cast("string"))).alias("token"))
    # By token first: a token is counted once, without a set of all tokens of a user; days are few.
    tokens = e.groupBy("user_id", "generation", "token").agg(F.count("*").alias("n"))
    days = tokens.groupBy("user_id", "generation").agg(F.sum("n").alias("issued"), F.count("*").alias("tokens"))
    days = days.withColumn("now", F.max("generation").over(Window.partitionBy("user_id")))
    stale = F.sum(F.when(F.col("generation") < F.col("now"), F.col("issued")).otherwise(0))
    return days.groupBy("user_id").agg(F.sum("issued").alias("issued"), (F.sum("issued") == F.sum("tokens")).alias("never_reused"), stale.alias("stale"))


@query("""WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN NULL ELSE 'src' || conv_id % 40 || '-rag' END AS db FROM conversations),
g AS (SELECT source || '-rag' AS name, 'Documents of ' || source AS hint FROM documents GROUP BY source)
SELECT conv_id, turn, CASE WHEN db IS NULL THEN 'database_required' WHEN hint IS NULL THEN 'database_unknown' ELSE 'ok' END AS status, hint, CASE WHEN db IS NULL THEN (SELECT count(*) FROM g) ELSE 0 END AS candidates FROM r LEFT JOIN g ON name = db""")
def routed_requests(spark, sf_dir):
    """Without a database a request gets the candidates and no search runs; with one it gets that database's hint."""
    db = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("src"), (F.col("conv_id") % 40).cast("string"), F.lit("-rag")))
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", db.alias("db"))
    g = table(spark, sf_dir, "documents").select("source").distinct().select(F.concat("source", F.lit("-rag")).alias("name"), F.concat(F.lit("Documents of "), "source").alias("hint"))
    n = g.agg(F.count("*").alias("n"))
    status = F.when(F.col("db").isNull(), "database_required").when(F.col("hint").isNull(), "database_unknown").otherwise("ok")
    return r.join(g, F.col("name") == F.col("db"), "left").crossJoin(F.broadcast(n)).select("conv_id", "turn", status.alias("status"), "hint", F.when(F.col("db").isNull(), F.col("n")).otherwise(0).alias("candidates"))


@query("""WITH d AS (SELECT doc_id, lang, source, n_chars FROM documents) SELECT doc_id, 'json' AS format, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}' AS body FROM d
UNION ALL SELECT doc_id, 'prompt', '[E1] (' || doc_id || ') ' || source || ', ' || lang FROM d UNION ALL SELECT doc_id, 'text', source || chr(10) || lang || chr(10) || n_chars FROM d""")
def result_delivery(spark, sf_dir):
    """One result in the three formats that a caller may ask for."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    bodies = {
        "json": F.to_json(F.struct("doc_id", "lang", "source"), {"ignoreNullFields": "false"}),
        "prompt": F.format_string("[E1] (%s) %s, %s", F.col("doc_id").cast("string"), "source", "lang"),
        "text": F.concat_ws("\n", "source", "lang", F.col("n_chars").cast("string")),
    }
    return d.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("format"), c.alias("body")) for k, c in bodies.items()])))
