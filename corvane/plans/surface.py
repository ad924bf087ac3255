"""M5: the read surface: registry, validation, limits, redaction, evidence detail."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.base import query
from corvane.sources.tables import table

#: Fixed values of the contract.
MAX_QUESTION, MAX_COUNT, MAX_TYPES, MAX_EVIDENCE, MAX_RESULT, STALE_DAYS = 16_000, 1_000_000, 20, 3, 8_192, 30


@query("""WITH g AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT source || '-rag' AS name, 'Documents of ' || source AS title, sum(n)::BIGINT AS source_count, string_agg(lang || ':' || n, ',' ORDER BY lang) AS source_types FROM g GROUP BY source""")
def registry(spark, sf_dir):
    """Routing reads this table alone: its plan has no text column and no chunk."""
    g = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    types = F.array_sort(F.collect_list(F.concat("lang", F.lit(":"), F.col("n").cast("string"))))
    return g.groupBy("source").agg(F.sum("n").alias("source_count"), F.array_join(types, ",").alias("source_types")).select(
        F.concat("source", F.lit("-rag")).alias("name"), F.concat(F.lit("Documents of "), "source").alias("title"), "source_count", "source_types"
    )


@query("""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
i AS (SELECT source, n, k, CASE WHEN k % 7 = 0 THEN '' WHEN k % 3 = 0 THEN 'T' || k // 2 ELSE 't' || k // 2 END AS type, CASE WHEN k % 5 = 0 THEN -1 WHEN k % 11 = 0 THEN 1000001 ELSE k * n END AS count FROM g, range(25) r(k)),
s AS (SELECT *, CASE WHEN count BETWEEN 0 AND 1000000 THEN count END AS valid FROM i WHERE k < 20 AND type <> '')
SELECT source || '-rag' AS name, count(*) AS n_types, sum(valid)::BIGINT AS total, count(*) FILTER (valid IS NULL) AS n_dropped, min(type) AS first_type, count(DISTINCT lower(type)) = count(*) AS unique_names FROM s GROUP BY source""")
def registry_sanitize(spark, sf_dir):
    """The first 20 items are taken before any is checked; a count out of range is left out, its item isn't."""
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    k = lambda x: x.cast("string")
    half = lambda x: k(F.floor(x / 2))
    item = lambda x: F.struct(
        F.when(x % 7 == 0, "").when(x % 3 == 0, F.concat(F.lit("T"), half(x))).otherwise(F.concat(F.lit("t"), half(x))).alias("type"),
        F.when(x % 5 == 0, F.lit(-1)).when(x % 11 == 0, F.lit(1_000_001)).otherwise(x * F.col("n")).cast("long").alias("count"),
    )
    raw = g.withColumn("items", F.transform(F.sequence(F.lit(0), F.lit(24)), item))
    kept = raw.withColumn("items", F.filter(F.slice("items", 1, MAX_TYPES), lambda x: x["type"] != ""))
    kept = kept.withColumn("counts", F.transform("items", lambda x: F.when(x["count"].between(0, MAX_COUNT), x["count"])))
    names = F.transform("items", lambda x: T.casefold(x["type"]))
    return kept.select(
        F.concat("source", F.lit("-rag")).alias("name"), F.size("items").cast("long").alias("n_types"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("long"))).alias("total"),
        F.size(F.filter("counts", lambda x: x.isNull())).cast("long").alias("n_dropped"), F.array_min(F.transform("items", lambda x: x["type"])).alias("first_type"), (F.size(F.array_distinct(names)) == F.size("items")).alias("unique_names"),
    )


@query("SELECT doc_id, CASE WHEN strlen(text) > 8192 THEN 'response_too_large' ELSE 'ok' END AS status, CASE WHEN strlen(text) <= 8192 THEN sha256(text) END AS content FROM documents")
def size_guard(spark, sf_dir):
    """Too large a result gives its status and nothing of its content."""
    fits = F.octet_length("text") <= MAX_RESULT
    return table(spark, sf_dir, "documents").select("doc_id", F.when(fits, "ok").otherwise("response_too_large").alias("status"), F.when(fits, T.sha(F.col("text"))).alias("content"))


#: What must not be shipped, and what may in spite of that.
FORBIDDEN_PARTS, FORBIDDEN_SUFFIXES, FORBIDDEN_PREFIXES, ALLOWED = ("fr", "logs"), (".html",), ("2", "~"), r"\A(?i)(?:blog|www)\..*\.html\z"
PATH_SQL = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(rf"""WITH p AS (SELECT page_id, {PATH_SQL} AS path FROM pages), r AS (SELECT page_id, path, list_has_any(string_split(lower(path), '/'), ['fr', 'logs']) AS part, regexp_matches(lower(path), '\.html$') AS suffix,
regexp_matches(list_extract(string_split(path, '/'), -1), '^(2|~)') AS prefix, regexp_matches(path, '^(?i)(?:blog|www)\..*\.html$') AS allowed FROM p)
SELECT count(*) AS n, count(*) FILTER (part) AS by_part, count(*) FILTER (suffix) AS by_suffix, count(*) FILTER (prefix) AS by_prefix, count(*) FILTER ((part OR suffix OR prefix) AND NOT allowed) AS forbidden,
count(*) FILTER ((part OR suffix OR prefix) AND NOT allowed) = 0 AS passes FROM r""")
def forbidden_names(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    p = table(spark, sf_dir, "pages").select(path.alias("path"))
    part = F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(*[F.lit(x) for x in FORBIDDEN_PARTS]))
    suffix = T.suffix(F.col("path")).isin(*FORBIDDEN_SUFFIXES)
    prefix = T.basename(F.col("path")).rlike(r"\A(?:" + "|".join(FORBIDDEN_PREFIXES) + ")")
    bad = (part | suffix | prefix) & ~F.col("path").rlike(ALLOWED)
    return p.agg(F.count("*").alias("n"), F.count_if(part).alias("by_part"), F.count_if(suffix).alias("by_suffix"), F.count_if(prefix).alias("by_prefix"), F.count_if(bad).alias("forbidden"), (F.count_if(bad) == 0).alias("passes"))


@query("""WITH k AS (SELECT event_id, event_type, json_keys(CASE WHEN event_id % 10 = 0 THEN '{"k": 1, "debug": true}' ELSE props END) AS keys FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (len(list_filter(keys, lambda x: x <> 'k')) > 0) AS with_unknown, count(*) FILTER (keys = ['k']) AS exact_keys, count(*) FILTER (trim(event_type) = '') AS blanks FROM k GROUP BY event_type""")
def key_difference(spark, sf_dir):
    props = F.when(F.col("event_id") % 10 == 0, '{"k": 1, "debug": true}').otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_type", F.json_object_keys(props).alias("keys"))
    allowed = F.array(F.lit("k"))
    same = (F.size(F.array_except("keys", allowed)) == 0) & (F.size(F.array_except(allowed, "keys")) == 0)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.size(F.array_except("keys", allowed)) > 0).alias("with_unknown"), F.count_if(same).alias("exact_keys"), F.count_if(T.blank(F.col("event_type"))).alias("blanks"))


@query(f"""WITH p AS (SELECT split_part(path, '/', 1) AS host, path FROM (SELECT {PATH_SQL} AS path FROM pages)), r AS (SELECT host, path, row_number() OVER (PARTITION BY host ORDER BY length(path) DESC, path) AS k FROM (SELECT DISTINCT * FROM p))
SELECT host, max(k) AS n, string_agg(path, ' ' ORDER BY k) FILTER (k <= 3) AS longest FROM r GROUP BY host""")
def array_caps(spark, sf_dir):
    """The three longest paths of each host, children before the folders that hold them."""
    from pyspark.sql import Window

    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    p = table(spark, sf_dir, "pages").select(path.alias("path")).distinct().withColumn("host", F.element_at(F.split("path", "/"), 1))
    w = Window.partitionBy("host").orderBy(F.length("path").desc(), "path")
    top = F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "path"))))
    return p.withColumn("k", F.row_number().over(w).cast("long")).groupBy("host").agg(F.max("k").alias("n"), F.array_join(F.transform(top, lambda x: x["path"]), " ").alias("longest"))


@query("SELECT source, lang, n, row_number() OVER (ORDER BY lower(name), name) AS place FROM (SELECT source, lang, count(*) AS n, CASE WHEN lang = 'en' THEN upper(source) ELSE source END || '-' || lang AS name FROM documents GROUP BY ALL)")
def name_order(spark, sf_dir):
    """Names of databases: as many as the registry has, so one window orders them."""
    from pyspark.sql import Window

    g = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    name = F.concat(F.when(F.col("lang") == "en", F.upper("source")).otherwise(F.col("source")), F.lit("-"), "lang")
    g = g.withColumn("name", name)
    return g.select("source", "lang", "n", F.row_number().over(Window.orderBy(F.lower("name"), "name")).cast("long").alias("place"))


@query(r"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn = 3 THEN '  ' || chr(10) WHEN turn = 4 THEN repeat(text, 40) ELSE text END AS question, CASE turn % 4 WHEN 0 THEN role || '-rag' WHEN 1 THEN '-bad-rag' WHEN 2 THEN NULL ELSE 'A.b_c-rag' || chr(10) END AS db FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(question, '^\s*$') THEN 'question_blank' WHEN length(question) > 16000 THEN 'question_too_long' WHEN contains(question, chr(0)) THEN 'question_nul'
WHEN db IS NOT NULL AND NOT regexp_full_match(db, '[A-Za-z0-9][A-Za-z0-9_.-]*-rag') THEN 'database_invalid' ELSE 'ok' END AS code FROM r""")
def request_validate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    question = F.when(F.col("turn") == 3, "  \n").when(F.col("turn") == 4, F.repeat("text", 40)).otherwise(F.col("text"))
    m = F.col("turn") % 4
    db = F.when(m == 0, F.concat("role", F.lit("-rag"))).when(m == 1, "-bad-rag").when(m == 3, "A.b_c-rag\n")
    return c.select("conv_id", "turn", validate(question, db).alias("code"))


def validate(question, db):
    """The first rule that a request breaks."""
    return (
        F.when(question.isNull() | T.blank(question), "question_blank").when(F.length(question) > MAX_QUESTION, "question_too_long").when(F.contains(question, F.lit("\0")), "question_nul")
        .when(db.isNotNull() & ~db.rlike(T.DB_NAME), "database_invalid").otherwise("ok")
    )


REDACTED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{}', '[email]', 'g'), '{}', '[hex40]', 'g'), '{}', '[digits16]', 'g'), '{}', '[ipv4]', 'g')".format(*T.IDENTIFIERS.values())


@query(f"WITH r AS (SELECT doc_id, text, {REDACTED} AS clean FROM documents) SELECT doc_id, sha256(clean) AS sha, clean <> text AS changed, NOT regexp_matches(clean, '{'|'.join(T.IDENTIFIERS.values())}') AS passes FROM r")
def redact(spark, sf_dir):
    clean = F.col("text")
    for kind, pattern in T.IDENTIFIERS.items():
        clean = F.regexp_replace(clean, pattern, f"[{kind}]")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", clean.alias("clean"))
    return d.select("doc_id", T.sha(F.col("clean")).alias("sha"), (F.col("clean") != F.col("text")).alias("changed"), (~F.col("clean").rlike("|".join(T.IDENTIFIERS.values()))).alias("passes"))


@query("""WITH r AS (SELECT conv_id, list('E' || (turn % 3 + 1)) AS ids FROM conversations GROUP BY conv_id)
SELECT conv_id, len(ids)::BIGINT AS n, CASE WHEN conv_id % 5 = 0 THEN 'stale_result' WHEN len(ids) > 3 THEN 'too_many_ids' WHEN len(list_distinct(ids)) < len(ids) THEN 'duplicate_id' ELSE 'ok' END AS status FROM r""")
def evidence_detail(spark, sf_dir):
    """Counts decide: no list of a conversation's ids is brought together."""
    r = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct(F.col("turn") % 3).alias("distinct"))
    status = F.when(F.col("conv_id") % 5 == 0, "stale_result").when(F.col("n") > MAX_EVIDENCE, "too_many_ids").when(F.col("distinct") < F.col("n"), "duplicate_id").otherwise("ok")
    return r.select("conv_id", "n", status.alias("status"))


@query("SELECT user_id, date_diff('day', max(ts)::DATE, DATE '2024-02-28')::BIGINT AS age, date_diff('day', max(ts)::DATE, DATE '2024-02-28') >= 30 AS warn FROM events GROUP BY user_id")
def freshness(spark, sf_dir):
    age = F.datediff(F.lit("2024-02-28").cast("date"), F.max(F.col("ts").cast("date"))).cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(age.alias("age")).withColumn("warn", F.col("age") >= STALE_DAYS)


@query(r"""WITH m AS (SELECT doc_id, md5(text) AS h, strlen(text) AS n FROM documents), u AS (SELECT doc_id, n, CASE WHEN doc_id % 3 = 0 THEN upper(x) ELSE x END AS id FROM (SELECT doc_id, n, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS x FROM m))
SELECT doc_id, CASE WHEN NOT regexp_full_match(id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN 'bad_id' WHEN n < 2 OR n > 2097152 THEN 'bad_size' WHEN doc_id % 7 = 0 THEN 'size_differs' ELSE 'ok' END AS code FROM u""")
def summary_check(spark, sf_dir):
    h = F.md5("text")
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.upper(uuid)).otherwise(uuid).alias("id"), F.octet_length("text").alias("n"))
    recorded = F.when(F.col("doc_id") % 7 == 0, F.col("n") + 1).otherwise(F.col("n"))
    code = F.when(~F.col("id").rlike(T.UUID), "bad_id").when((F.col("n") < 2) | (F.col("n") > 2 << 20), "bad_size").when(recorded != F.col("n"), "size_differs").otherwise("ok")
    return d.select("doc_id", code.alias("code"))
