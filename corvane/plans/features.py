"""M1 and M2: corpus statistics, BM25, must-hit ranks, and the features of documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corvane.functions import text as T
from corvane.operators import features, lanes
from corvane.plans.base import query
from corvane.sources import files
from corvane.sources.tables import table

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
BM25 = rf"""
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
d AS (SELECT doc_id, {TOKENS} AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avg_dl FROM d),
t AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
cand AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
  FROM q JOIN f USING (term) JOIN t USING (term), s GROUP BY query_id, doc_id),
lexical AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM cand) WHERE rank <= 8)
"""


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25(spark, sf_dir):
    return lanes.lexical(table(spark, sf_dir, "documents").select("doc_id", "text"), questions(spark, sf_dir))


@query(f"SELECT doc_id, len(ts)::BIGINT AS n_tokens, len(list_distinct(ts))::BIGINT AS n_terms FROM (SELECT doc_id, {TOKENS} AS ts FROM documents)")
def token_counts(spark, sf_dir):
    ts = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ts).cast("long").alias("n_tokens"), F.size(F.array_distinct(ts)).cast("long").alias("n_terms"))


@query(f"""SELECT count(DISTINCT doc_id) AS n_docs, sum(tf)::BIGINT AS n_tokens, count(DISTINCT term) AS n_terms, round(sum(tf) / (SELECT count(*) FROM documents), 6) AS avg_tokens
FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL)""")
def corpus_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Terms are counted once by term and once more by count, never by a distinct over all rows.
    p = features.postings(docs)
    terms = p.groupBy("term").agg(F.sum("tf").alias("tf")).agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"))
    ts = F.size(T.tokens(F.col("text")))
    sizes = docs.agg(F.count("*").alias("rows"), F.count_if(ts > 0).alias("n_docs"))
    return terms.crossJoin(sizes).select("n_docs", "n_tokens", "n_terms", F.round(F.col("n_tokens") / F.col("rows"), 6).alias("avg_tokens"))


@query(f"WITH {BM25} SELECT query_id, rank, doc_id, score FROM lexical")
def bm25_topk(spark, sf_dir):
    return bm25(spark, sf_dir)


@query(f"""WITH {BM25} SELECT b.item_id AS query_id, min(CASE WHEN contains(d.text, b.text) THEN rank END) AS must_hit_rank, count(CASE WHEN contains(d.text, b.text) THEN 1 END) AS n_hits, count(*) AS n_rows
FROM benchmark b JOIN lexical l ON l.query_id = b.item_id JOIN documents d ON d.doc_id = l.doc_id GROUP BY b.item_id""")
def must_hit_rank(spark, sf_dir):
    hits, q = bm25(spark, sf_dir), questions(spark, sf_dir).withColumnRenamed("text", "passage")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = F.contains("text", "passage")
    rows = docs.join(F.broadcast(hits) if _few(hits, q) else hits, "doc_id").join(q, "query_id")
    return rows.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("must_hit_rank"), F.count_if(hit).alias("n_hits"), F.count("*").alias("n_rows"))


def _few(hits, q, most: int = 100_000) -> bool:
    """Top-k rows are at most 8 for each question; they are broadcast if the questions are few."""
    return q.limit(most // 8 + 1).count() <= most // 8


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS content_sha256, length(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))::BIGINT AS n FROM documents")
def normalize_sha(spark, sf_dir):
    c = T.collapse(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.sha(c).alias("content_sha256"), F.length(c).cast("long").alias("n"))


CHUNKS = """c AS (SELECT doc_id, source, i AS chunk_index, i * 1240 AS start, substring(text, (i * 1240 + 1)::BIGINT, 1400) AS chunk
  FROM (SELECT doc_id, source, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1400 THEN 1 ELSE ceil((length(text) - 1400) / 1240)::BIGINT + 1 END)) AS i FROM documents))"""


def chunk_rows(spark, sf_dir):
    return features.chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, start, length(chunk)::BIGINT AS n_chars, sha256(chunk) AS sha FROM c")
def chunk_windows(spark, sf_dir):
    return chunk_rows(spark, sf_dir).select("doc_id", "chunk_index", "start", F.length("chunk").cast("long").alias("n_chars"), T.sha(F.col("chunk")).alias("sha"))


@query(f"""WITH {CHUNKS} SELECT sha256('src-' || source || '|' || doc_id || '|' || chunk_index) AS id, source AS source_id, source || '/' || doc_id || '.txt' AS path,
chunk_index, sha256('検索文書: ' || chunk) AS embedding_sha, length('検索文書: ' || chunk)::BIGINT AS embedding_chars FROM c""")
def chunk_records(spark, sf_dir):
    e = F.concat(F.lit(T.DOCUMENT_PREFIX), "chunk")
    return chunk_rows(spark, sf_dir).select(
        T.sha(F.concat(F.lit("src-"), "source", F.lit("|"), F.col("doc_id").cast("string"), F.lit("|"), F.col("chunk_index").cast("string"))).alias("id"),
        F.col("source").alias("source_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "chunk_index",
        T.sha(e).alias("embedding_sha"), F.length(e).cast("long").alias("embedding_chars"),
    )


@query(rf"""WITH {CHUNKS}, t AS (SELECT doc_id, chunk_index, len(regexp_extract_all(lower('検索文書: ' || chunk), '[\p{{L}}\p{{N}}]+'))::BIGINT AS n_tokens FROM c)
SELECT doc_id, chunk_index, n_tokens, n_tokens <= 256 AS within_budget FROM t""")
def token_budget(spark, sf_dir):
    n = F.size(T.tokens(F.concat(F.lit(T.DOCUMENT_PREFIX), "chunk"))).cast("long")
    return chunk_rows(spark, sf_dir).select("doc_id", "chunk_index", n.alias("n_tokens"), (n <= 256).alias("within_budget"))


LINES = r"list_filter(regexp_split_to_array({}, '\r\n|\n|\r'), lambda x: length(trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g'))) > 0)"


@query(f"""WITH l AS (SELECT doc_id, list_distinct({LINES.format('text')}) AS a, list_distinct({LINES.format('lower(text)')}) AS b FROM documents)
SELECT doc_id, len(a)::BIGINT AS n_lines, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS only_left, len(list_filter(b, lambda x: NOT list_contains(a, x)))::BIGINT AS only_right,
sha256(array_to_string(list_slice(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), 1, 8), chr(10))) AS first_left FROM l""")
def line_sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.lines(F.col("text"))).alias("a"), F.array_distinct(T.lines(F.lower("text"))).alias("b"))
    left, right = F.array_except("a", "b"), F.array_except("b", "a")
    size = lambda x: F.size(x).cast("long")
    return docs.select("doc_id", size(F.col("a")).alias("n_lines"), size(left).alias("only_left"), size(right).alias("only_right"), T.sha(F.concat_ws("\n", F.slice(F.array_sort(left), 1, 8))).alias("first_left"))


IDENTIFIERS = "p AS (SELECT doc_id, kind, identifier, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS identifier FROM documents" for k, p in T.IDENTIFIERS.items()) + ") GROUP BY ALL)"


@query(f"WITH {IDENTIFIERS} SELECT doc_id, kind, sha256(identifier) AS identifier_sha, n FROM p")
def identifier_postings(spark, sf_dir):
    """Identifiers are personal data: they leave the engine as hashes."""
    p = features.identifiers(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return p.select("doc_id", "kind", T.sha(F.col("identifier")).alias("identifier_sha"), "n")


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1) AS heading,
len(regexp_extract_all(html, '<p>'))::BIGINT AS n_paragraphs, len(regexp_extract_all(html, '<a href='))::BIGINT AS n_links,
length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')))::BIGINT AS text_chars FROM pages""")
def html_sections(spark, sf_dir):
    return features.html_sections(table(spark, sf_dir, "pages").select("page_id", "html"))


@query("""SELECT source, lang, count(*) AS n_docs, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, min(length(text))::BIGINT AS shortest, max(length(text))::BIGINT AS longest FROM documents GROUP BY source, lang""")
def doc_profile(spark, sf_dir):
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("n_docs"), F.sum(n).alias("chars"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.min(n).alias("shortest"), F.max(n).alias("longest")
    )


@query("""WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang <> 'en') AS n_other FROM documents GROUP BY source)
SELECT *, (SELECT min(n) = max(n) FROM g) AS all_equal FROM g""")
def files_per_source(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("lang") != "en").alias("n_other"))
    return g.crossJoin(F.broadcast(g.agg((F.min("n") == F.max("n")).alias("all_equal"))))  # one row


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, contains(lower(url), 'page=') AS paged FROM pages)
SELECT page_id, split_part(path, '/', 1) AS host, regexp_replace(path, '^[^/]*/', '') AS rest, list_extract(string_split(path, '/'), -1) AS base, lower(regexp_extract(list_extract(string_split(path, '/'), -1), '(\.[^.]+)$', 1)) AS suffix,
(len(string_split(path, '/')) - 1)::BIGINT AS depth, ends_with(path, '.html') AS is_html, paged FROM p""")
def path_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "").alias("path"), F.contains(F.lower("url"), F.lit("page=")).alias("paged"))
    c = F.col("path")
    return p.select(
        "page_id", F.element_at(F.split(c, "/"), 1).alias("host"), F.regexp_replace(c, r"^[^/]*/", "").alias("rest"), T.basename(c).alias("base"), T.suffix(c).alias("suffix"),
        (F.size(F.split(c, "/")) - 1).cast("long").alias("depth"), F.endswith(c, F.lit(".html")).alias("is_html"), "paged",
    )


@query("""SELECT doc_id, format('{:06d}', doc_id) || ' ' || coalesce(lang, 'und') AS name, '{"lang":"' || lang || '","n":' || n_chars || ',"source":"' || source || '"}' AS json FROM documents""")
def format_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    meta = F.struct("lang", F.col("n_chars").alias("n"), "source")  # keys in order: canonical
    return d.select("doc_id", F.format_string("%06d %s", "doc_id", F.coalesce("lang", F.lit("und"))).alias("name"), F.to_json(meta, {"ignoreNullFields": "false"}).alias("json"))


@query(r"SELECT doc_id, sha256(regexp_replace(text || chr(13) || chr(10) || 'end', '\r\n|\r', chr(10), 'g')) AS sha FROM documents")
def eol_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sha(F.regexp_replace(F.concat("text", F.lit("\r\nend")), "\r\n|\r", "\n")).alias("sha"))


@query("""SELECT event_id, true AS is_utf8, json_type(props) = 'OBJECT' AS is_object, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strlen(props)::BIGINT <= 1048576 AS within_limit FROM events""")
def utf8_json_check(spark, sf_dir):
    """Strict: text that isn't a JSON object is no object, whatever else it is."""
    parsed = F.from_json("props", ST.StructType([ST.StructField("k", ST.LongType())]), {"mode": "PERMISSIVE"})
    is_object = F.coalesce(F.startswith(F.schema_of_variant(files.parsed(F.col("props"))), F.lit("OBJECT")), F.lit(False))
    return table(spark, sf_dir, "events").select("event_id", F.is_valid_utf8("props").alias("is_utf8"), is_object.alias("is_object"), parsed["k"].alias("k"), (F.octet_length("props") <= 1 << 20).alias("within_limit"))
