"""M10: selection of files, query preparation, metadata fields, commits in groups and assertions over keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import features as build
from corvane.operators import lanes, maintenance
from corvane.plans import features
from corvane.plans.base import query
from corvane.plans.lanes import ABSENT, identifier_table
from corvane.sources.tables import table

#: Suffixes of all supported files, and of documents alone.
DOCUMENTS = (".docx", ".pptx", ".pdf", ".txt", ".md", ".asta", ".pu", ".puml", ".plantuml")
SUPPORTED = (*DOCUMENTS, ".py", ".yaml")
_NAMES = (".docx", ".md", ".py", ".puml", ".exe", ".yaml", ".TXT")
_SUFFIX = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_NAMES)) + " END"
_PATH = f"CASE WHEN doc_id % 3 = 0 THEN 'sub/' ELSE '' END || doc_id || {_SUFFIX}"


def _in(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


@query(f"""WITH p AS (SELECT source, lower({_SUFFIX}) AS suffix, {_PATH} AS path FROM documents)
SELECT source, count(*) FILTER (suffix IN ({_in(SUPPORTED)})) AS all_supported, count(*) FILTER (suffix IN ({_in(DOCUMENTS)})) AS documents_only, count(*) FILTER (suffix IN ({_in(DOCUMENTS)}) AND NOT contains(path, '/')) AS direct_children FROM p GROUP BY source""")
def content_profile(spark, sf_dir):
    """What two profiles select, and one of them without the folders below."""
    p = table(spark, sf_dir, "documents").select("source", F.expr(_PATH.replace("|| doc_id ||", "|| cast(doc_id AS string) ||")).alias("path"))
    path = F.col("path")
    count = lambda *a, **k: F.count_if(maintenance.selected(path, *a, **k))
    return p.groupBy("source").agg(count(SUPPORTED).alias("all_supported"), count(DOCUMENTS).alias("documents_only"), count(DOCUMENTS, recursive=False).alias("direct_children"))


@query("""SELECT 'any' AS selection, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents UNION ALL SELECT 'src2', count(*), sum(n_chars)::BIGINT FROM documents WHERE source = 'src2' UNION ALL SELECT 'none', count(*), sum(n_chars)::BIGINT FROM documents WHERE source = 'none'""")
def source_any(spark, sf_dir):
    """The source "any" filters nothing."""
    d = table(spark, sf_dir, "documents").select("source", "n_chars")
    out = None
    for name in ("any", "src2", "none"):
        one = lanes.of_source(d, name).agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars")).select(F.lit(name).alias("selection"), "n", "chars")
        out = one if out is None else out.unionByName(one)
    return out


FOLDED = "replace(replace(lower({}), 'ß', 'ss'), 'ς', 'σ')"


@query(f"""SELECT doc_id, contains({FOLDED.format('text')}, {FOLDED.format("'THE '")}) AS has_the, contains({FOLDED.format("'Straße ' || source")}, {FOLDED.format("'STRASSE SRC1'")}) AS has_source FROM documents""")
def folded_contains(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    has = lambda a, b: F.contains(T.casefold(a), T.casefold(F.lit(b)))
    return d.select("doc_id", has(F.col("text"), "THE ").alias("has_the"), has(F.concat(F.lit("Straße "), "source"), "STRASSE SRC1").alias("has_source"))


COUNTED = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in T.IDENTIFIERS.values())


@query(rf"""SELECT item_id AS query_id, sha256('検索クエリ: ' || trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS prefixed_sha, len(list_distinct({features.TOKENS}))::BIGINT AS n_terms, ({COUNTED})::BIGINT AS n_identifiers FROM benchmark""")
def query_preparation(spark, sf_dir):
    """What each lane gets of a question: the prefixed text for embedding, terms for the lexical lane, identifiers for the exact one."""
    q = build.prepared(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return q.select("query_id", T.sha(F.col("embedding_text")).alias("prefixed_sha"), F.size("terms").cast("long").alias("n_terms"), F.size("identifiers").cast("long").alias("n_identifiers"))


FIELDS = r"""p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1) AS heading FROM pages),
f AS (SELECT DISTINCT page_id, field, lower(value) AS value FROM (SELECT page_id, 'path' AS field, path AS value FROM p UNION ALL SELECT page_id, 'file', list_extract(string_split(path, '/'), -1) FROM p UNION ALL SELECT page_id, 'title', title FROM p UNION ALL SELECT page_id, 'heading', heading FROM p) WHERE value <> '')"""


@query(f"""WITH {FIELDS}, s AS (SELECT q.page_id AS query_id, d.page_id AS doc_id, count(*)::DOUBLE AS score FROM f q JOIN f d USING (field, value) WHERE q.page_id % 100 = 0 AND d.page_id <> q.page_id GROUP BY ALL)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s) WHERE rank <= 8""")
def metadata_fields(spark, sf_dir):
    """Pages by file, path, title and heading, for every page whose id is divisible by 100 as a question."""
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    found = build.html_sections(pages.select("page_id", "html")).select("page_id", "title", "heading").join(pages.select("page_id", path.alias("path")), "page_id")
    fields = build.metadata_postings(found.withColumnRenamed("page_id", "doc_id").withColumn("file", T.basename(F.col("path"))), ["file", "path", "title", "heading"])
    asked = fields.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return lanes.by_fields(fields, asked)


@query(f"""WITH {features.IDENTIFIERS},
q AS (SELECT DISTINCT doc_id AS query_id, identifier FROM p WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 'RFC999999' FROM documents WHERE doc_id % 50 = 0),
m AS (SELECT query_id, identifier, (SELECT count(*) FROM p WHERE p.identifier = q.identifier AND p.doc_id <> q.query_id) > 0 AS matched FROM q)
SELECT query_id, count(*) AS asked, count(*) FILTER (NOT matched) AS unmatched, CASE WHEN count(*) FILTER (NOT matched) = 0 THEN 'ok' ELSE 'partial' END AS status, CASE WHEN count(*) FILTER (NOT matched) > 0 THEN 'unmatched_identifiers' END AS warning FROM m GROUP BY query_id""")
def unmatched_identifiers(spark, sf_dir):
    """Which of a question's identifiers no other document has: they make an answer partial, with a warning."""
    p = identifier_table(spark, sf_dir).select("doc_id", "identifier").distinct()
    absent = table(spark, sf_dir, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.lit(ABSENT[0]).alias("identifier"))
    q = p.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "identifier").unionByName(absent)
    # Another document has it if more than the question's own one do: counts, no pairs.
    held = p.groupBy("identifier").agg(F.count("*").alias("held"))
    own = p.select(F.col("doc_id").alias("query_id"), "identifier", F.lit(1).alias("own"))
    rows = q.join(held, "identifier", "left").join(own, ["query_id", "identifier"], "left")
    unmatched = F.count_if(F.coalesce("held", F.lit(0)) - F.coalesce("own", F.lit(0)) <= 0)
    g = rows.groupBy("query_id").agg(F.count("*").alias("asked"), unmatched.alias("unmatched"))
    return g.withColumn("status", F.when(F.col("unmatched") == 0, "ok").otherwise("partial")).withColumn("warning", F.when(F.col("unmatched") > 0, "unmatched_identifiers"))


@query(f"""WITH {features.CHUNKS}, n AS (SELECT source, doc_id, count(*) AS records FROM c GROUP BY ALL), g AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS flush, records FROM n),
s AS (SELECT source, flush, sum(records) AS records, count(*) AS files FROM g GROUP BY ALL)
SELECT source, count(*) AS flushes, sum(files)::BIGINT AS files, sum(records)::BIGINT AS records, sum(ceil(records / 8))::BIGINT AS calls_8, sum(ceil(records / 128))::BIGINT AS calls_128 FROM s GROUP BY source""")
def flush_groups(spark, sf_dir):
    """Five files are a flush, and each flush is written in batches, the last one smaller."""
    n = features.chunk_rows(spark, sf_dir).groupBy("source", "doc_id").agg(F.count("*").alias("records"))
    s = maintenance.flushes(n, "source", "doc_id", 5).groupBy("source", "flush").agg(F.sum("records").alias("records"), F.count("*").alias("files"))
    calls = lambda b: F.sum(F.ceil(F.col("records") / b))
    return s.groupBy("source").agg(F.count("*").alias("flushes"), F.sum("files").alias("files"), F.sum("records").alias("records"), calls(8).alias("calls_8"), calls(128).alias("calls_128"))


@query("""WITH g AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS flush FROM documents), s AS (SELECT source, flush, count(*) AS n FROM g GROUP BY ALL)
SELECT source, 'every_5' AS policy, count(*) AS checkpoints, count(*) AS applies, max(n) AS most_lost FROM s GROUP BY source UNION ALL SELECT source, 'once', count(*), 1, sum(n)::BIGINT FROM s GROUP BY source""")
def commit_points(spark, sf_dir):
    """Issues are checkpointed five at a time; some sources also apply them then, others once at the end, and lose that much in a failure."""
    s = maintenance.flushes(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5).groupBy("source", "flush").agg(F.count("*").alias("n"))
    g = s.groupBy("source").agg(F.count("*").alias("checkpoints"), F.max("n").alias("most"), F.sum("n").alias("all"))
    policies = F.array(F.struct(F.lit("every_5").alias("policy"), F.col("checkpoints").alias("applies"), F.col("most").alias("most_lost")), F.struct(F.lit("once").alias("policy"), F.lit(1).cast("long").alias("applies"), F.col("all").alias("most_lost")))
    return g.select("source", "checkpoints", F.inline(policies)).select("source", "policy", "checkpoints", "applies", "most_lost")


@query("""WITH e AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 3 FROM labels WHERE doc_id % 20 = 0), n AS (SELECT doc_id, (SELECT count(*) FROM documents d WHERE d.doc_id = e.doc_id) AS matches, count(*) AS asked FROM e GROUP BY doc_id)
SELECT CASE WHEN matches = 0 THEN 'missing' WHEN asked > 1 THEN 'repeated' ELSE 'exactly_one' END AS outcome, count(*) AS keys FROM n GROUP BY 1""")
def exactly_one(spark, sf_dir):
    """Expected keys and how often each is met; anything but once is a failure."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    expected = labels.unionByName(labels.filter("doc_id % 20 = 0").select((F.col("doc_id") + 3).alias("doc_id")))
    return maintenance.matches(expected, table(spark, sf_dir, "documents").select("doc_id"), "doc_id").groupBy("outcome").agg(F.count("*").alias("keys"))


@query("""WITH s AS (SELECT user_id % 4 AS cohort, count(*) FILTER (event_type = 'click') AS n_base, count(*) FILTER (event_type = 'view') AS n_candidate FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT cohort, n_base, n_candidate, n_base = n_candidate AS same_length FROM s""")
def pair_lengths(spark, sf_dir):
    """Positional pairs are sound only if both sides have the same length."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    g = e.groupBy((F.col("user_id") % 4).alias("cohort")).agg(F.count_if(F.col("event_type") == "click").alias("n_base"), F.count_if(F.col("event_type") == "view").alias("n_candidate"))
    return g.withColumn("same_length", F.col("n_base") == F.col("n_candidate"))


@query(rf"""WITH p AS (SELECT lower(list_extract(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), -1)) AS name, contains(url, 'page=') AS paged FROM pages),
d AS (SELECT name FROM p WHERE paged EXCEPT SELECT name FROM p WHERE NOT paged) SELECT name, row_number() OVER (ORDER BY name) AS place, (SELECT count(*) FROM d) AS n FROM d ORDER BY name LIMIT 8""")
def difference_head(spark, sf_dir):
    """Names on one side alone: the first eight in order, and how many there are."""
    name = F.lower(T.basename(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")))
    p = table(spark, sf_dir, "pages").select(name.alias("name"), F.contains("url", F.lit("page=")).alias("paged"))
    d = p.filter("paged").select("name").distinct().join(p.filter("NOT paged").select("name").distinct(), "name", "left_anti")
    top = d.orderBy("name").limit(8)  # eight rows meet in one window
    return top.withColumn("place", F.row_number().over(Window.orderBy("name")).cast("long")).crossJoin(F.broadcast(d.agg(F.count("*").alias("n"))))
