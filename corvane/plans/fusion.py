"""M4: fusion of the lanes, suppression, context, budget and labels, for all benchmark questions at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import features as chunking
from corvane.operators import fusion
from corvane.operators import lanes as retrieval
from corvane.plans import features, lanes
from corvane.plans.base import query
from corvane.sources.tables import table
from corvane.sources.work import written

#: The dense lane has no key to documents: vec_id = doc_id is a synthetic link, for these demonstrations alone.
#: A question's exact evidence is the whole passage as one line of the document's text.
LANES = f"""{features.BM25}, {lanes.DENSE},
exact_q AS (SELECT b.item_id AS query_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
u AS (SELECT query_id, doc_id, rank, 'lexical' AS lane FROM lexical UNION ALL SELECT query_id / 100, doc_id, rank, 'dense' FROM dense WHERE query_id % 100 = 0 UNION ALL SELECT query_id, doc_id, rank, 'exact' FROM exact_q),
fused AS (SELECT query_id::BIGINT AS query_id, doc_id, round(sum((CASE lane WHEN 'exact' THEN 3.0::DOUBLE WHEN 'lexical' THEN 1.0::DOUBLE WHEN 'dense' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) / (60 + rank)), 6) AS score, array_to_string(list_sort(list_distinct(list(lane))), ',') AS signals FROM u GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN list_contains(string_split(signals, ','), 'exact') THEN 0 ELSE 1 END, score DESC, doc_id) AS rank FROM fused)"""
LANES = LANES.replace("SELECT query_id / 100, doc_id", "SELECT query_id // 100, doc_id")


def exact_and_lexical(spark, sf_dir):
    """The exact lane is sought in all documents, not among BM25's best eight."""
    found = retrieval.passages(table(spark, sf_dir, "documents").select("doc_id", "text"), features.questions(spark, sf_dir))
    # Lanes are a few rows of each question, found once and read wherever they are used.
    return {"lexical": written(features.bm25(spark, sf_dir), "lexical"), "exact": written(fusion.order_hits(found.withColumn("score", F.lit(0)), anchors_first=False), "exact")}


def all_lanes(spark, sf_dir):
    return exact_and_lexical(spark, sf_dir) | {"dense": written(lanes.dense(spark, sf_dir).withColumn("query_id", F.expr("query_id div 100")), "dense")}


def hits(spark, sf_dir):
    return written(fusion.order_hits(fusion.fuse(fusion.union_lanes(all_lanes(spark, sf_dir)))), "hits")


@query(f"WITH {LANES} SELECT * FROM fused")
def rrf_fusion(spark, sf_dir):
    return fusion.fuse(fusion.union_lanes(all_lanes(spark, sf_dir)))


@query(f"WITH {LANES} SELECT query_id, doc_id, score, signals, rank FROM ranked")
def anchor_first(spark, sf_dir):
    return hits(spark, sf_dir)


CONTENT = r"""content AS (SELECT r.*, sha256(trim(regexp_replace(d.text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS content FROM ranked r JOIN documents d USING (doc_id)),
single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY rank, doc_id) AS copy FROM content) WHERE copy = 1)"""


def documents_of(spark, sf_dir, found):
    """The documents of a few stored hits: what is made of their texts is made of no other text."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(found.select("doc_id").distinct(), "doc_id", "left_semi")


def single_hits(spark, sf_dir):
    found = hits(spark, sf_dir)
    docs = documents_of(spark, sf_dir, found).select("doc_id", T.sha(T.collapse(F.col("text"))).alias("content"))
    return fusion.drop_repeats(found.join(docs, "doc_id"))


@query(f"WITH {LANES}, {CONTENT} SELECT query_id, doc_id, rank, content FROM single")
def dedupe_hits(spark, sf_dir):
    return single_hits(spark, sf_dir).select("query_id", "doc_id", "rank", "content")


#: Hits as chunks: every chunk of a hit document that holds a token of the question, best document first.
CHUNK_HITS = rf"""{features.CHUNKS},
ch AS (SELECT s.query_id, s.doc_id, s.rank, c.chunk_index, length(c.chunk)::BIGINT AS chars, len(list_intersect(list_distinct(regexp_extract_all(lower(c.chunk), '[\p{{L}}\p{{N}}]+')), list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}]+'))))::BIGINT AS overlap
  FROM single s JOIN c ON c.doc_id = s.doc_id JOIN benchmark b ON b.item_id = s.query_id),
capped AS (SELECT * FROM (SELECT query_id, doc_id, rank, chunk_index, chars, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, chunk_index) AS of_document FROM ch WHERE overlap >= 8) WHERE of_document <= 2)"""


def chunk_hits(spark, sf_dir, *more: str):
    """With more columns of the hits, if asked."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(T.tokens(F.col("text"))).alias("asked"))
    found = written(single_hits(spark, sf_dir).select("query_id", "doc_id", "rank", *more), "single-hits")
    c = chunking.chunks(documents_of(spark, sf_dir, found)).select("doc_id", "chunk_index", "chunk")
    rows = found.join(c, "doc_id").join(q, "query_id")
    rows = rows.filter(F.size(F.array_intersect(F.array_distinct(T.tokens(F.col("chunk"))), "asked")) >= 8)
    return fusion.cap_per_document(rows.select("query_id", "doc_id", "rank", "chunk_index", F.length("chunk").cast("long").alias("chars"), *more))


@query(f"WITH {LANES}, {CONTENT}, {CHUNK_HITS} SELECT * FROM capped")
def doc_cap(spark, sf_dir):
    return chunk_hits(spark, sf_dir)


@query(f"""WITH {LANES}, {CONTENT}, {CHUNK_HITS} SELECT h.query_id, h.doc_id, h.chunk_index AS hit_index, c.chunk_index, 'same_section_neighbor' AS reason FROM capped h JOIN c ON c.doc_id = h.doc_id AND abs(c.chunk_index - h.chunk_index) = 1
WHERE NOT EXISTS (SELECT 1 FROM capped x WHERE x.query_id = h.query_id AND x.doc_id = h.doc_id AND x.chunk_index = c.chunk_index)""")
def neighbor_context(spark, sf_dir):
    near = fusion.neighbours(chunk_hits(spark, sf_dir), features.chunk_rows(spark, sf_dir))
    return near.select("query_id", "doc_id", "hit_index", "chunk_index", F.lit("same_section_neighbor").alias("reason"))


#: Evidence in the order of documents, then chunks.
PACKED = """o AS (SELECT query_id, doc_id, chunk_index, chars, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_index) AS rank FROM capped),
packed AS (SELECT * FROM (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM o) WHERE used <= 6000)"""


def evidence(spark, sf_dir, *more: str):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("rank", "chunk_index")
    rows = chunk_hits(spark, sf_dir, *more).select("query_id", "doc_id", "chunk_index", "chars", *more, F.row_number().over(w).cast("long").alias("rank"))
    return fusion.pack(rows, 6000)


@query(f"WITH {LANES}, {CONTENT}, {CHUNK_HITS}, {PACKED} SELECT query_id, doc_id, chunk_index, chars, rank, used FROM packed")
def budget_pack(spark, sf_dir):
    return evidence(spark, sf_dir)


@query(f"WITH {LANES}, {CONTENT}, {CHUNK_HITS}, {PACKED} SELECT query_id, doc_id, chunk_index, 'E' || row_number() OVER (PARTITION BY query_id ORDER BY rank) AS label FROM packed")
def evidence_label(spark, sf_dir):
    return fusion.label(evidence(spark, sf_dir)).select("query_id", "doc_id", "chunk_index", "label")


@query(f"""WITH {LANES}, {CONTENT}, {CHUNK_HITS}, {PACKED} SELECT b.item_id AS query_id, count(DISTINCT p.doc_id) AS coverage_documents, count(p.doc_id) AS n_evidence,
coalesce(bool_or(contains(r.signals, 'exact')), false) AS anchored, CASE WHEN count(p.doc_id) = 0 THEN 'partial' ELSE 'ok' END AS status, CASE WHEN coalesce(bool_or(contains(r.signals, 'exact')), false) THEN 'answerable' ELSE 'uncertain' END AS answerability
FROM benchmark b LEFT JOIN packed p ON p.query_id = b.item_id LEFT JOIN ranked r ON r.query_id = p.query_id AND r.doc_id = p.doc_id GROUP BY b.item_id""")
def answer_status(spark, sf_dir):
    """Neighbours don't count, and a score never makes an answer: exact evidence does."""
    rows = evidence(spark, sf_dir, "signals").withColumn("exact", F.contains("signals", F.lit("exact")))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    g = q.join(rows, "query_id", "left").groupBy("query_id").agg(F.count_distinct("doc_id").alias("coverage_documents"), F.count("doc_id").alias("n_evidence"), F.coalesce(F.bool_or("exact"), F.lit(False)).alias("anchored"))
    return g.withColumn("status", F.when(F.col("n_evidence") == 0, "partial").otherwise("ok")).withColumn("answerability", F.when(F.col("anchored"), "answerable").otherwise("uncertain"))


@query(f"""WITH {LANES}, x AS (SELECT query_id, doc_id, lane, rank FROM u UNION ALL SELECT query_id, doc_id, 'hybrid', rank FROM ranked WHERE rank <= 8)
SELECT query_id::BIGINT AS query_id, doc_id, min(rank) FILTER (lane = 'hybrid') AS hybrid, min(rank) FILTER (lane = 'lexical') AS lexical, min(rank) FILTER (lane = 'dense') AS dense, min(rank) FILTER (lane = 'exact') AS exact FROM x GROUP BY ALL""")
def lane_compare(spark, sf_dir):
    found = all_lanes(spark, sf_dir)
    hybrid = fusion.order_hits(fusion.fuse(fusion.union_lanes(found))).filter("rank <= 8")
    rows = fusion.union_lanes(found | {"hybrid": hybrid})
    return rows.groupBy("query_id", "doc_id").agg(*[F.min(F.when(F.col("lane") == n, F.col("rank"))).alias(n) for n in ("hybrid", "lexical", "dense", "exact")])


@query(f"""WITH {LANES}, m AS (SELECT query_id // 3 AS chat, doc_id, min(rank) AS best, count(*) AS views FROM ranked GROUP BY ALL)
SELECT chat::BIGINT AS chat, doc_id, best, views, 'R' || (chat + 1)::BIGINT || '-E' || row_number() OVER (PARTITION BY chat ORDER BY views DESC, best, doc_id) AS label FROM m""")
def multi_view_merge(spark, sf_dir):
    """Three questions are one chat, views of one need: their searches are merged by document."""
    from pyspark.sql import Window

    rows = hits(spark, sf_dir).withColumn("chat", F.expr("query_id div 3"))
    m = rows.groupBy("chat", "doc_id").agg(F.min("rank").alias("best"), F.count("*").alias("views"))
    w = Window.partitionBy("chat").orderBy(F.col("views").desc(), "best", "doc_id")
    return m.withColumn("label", F.concat(F.lit("R"), (F.col("chat") + 1).cast("string"), F.lit("-E"), F.row_number().over(w).cast("string")))


@query(f"""WITH {LANES} SELECT query_id, r.doc_id, r.rank, coalesce('https://docs.example.com/' || source || '/' || r.doc_id, 'none') AS link, source || '-rag' AS db FROM ranked r LEFT JOIN documents d USING (doc_id)""")
def source_links(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = hits(spark, sf_dir).select("query_id", "doc_id", "rank").join(d, "doc_id", "left")
    link = F.concat(F.lit("https://docs.example.com/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return rows.select("query_id", "doc_id", "rank", F.coalesce(link, F.lit("none")).alias("link"), F.concat("source", F.lit("-rag")).alias("db"))
