"""M11: answers in their parts: the fast path, token budgets, evidence, background and documents, views up to a cap, row summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import features as chunking
from corvane.operators import fusion
from corvane.operators import lanes as retrieval
from corvane.plans import features, lanes
from corvane.plans import fusion as plan
from corvane.plans.base import query
from corvane.sources.tables import table
from corvane.sources.work import written

SCORE = "round(sum((CASE lane WHEN 'exact' THEN 3.0::DOUBLE WHEN 'lexical' THEN 1.0::DOUBLE WHEN 'dense' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) / (60 + rank)), 6) AS score, array_to_string(list_sort(list_distinct(list(lane))), ',') AS signals"


@query(f"""WITH {plan.LANES} SELECT query_id::BIGINT AS query_id, doc_id, {SCORE}, query_id IN (SELECT query_id FROM exact_q) AS fast FROM u WHERE lane <> 'dense' OR query_id NOT IN (SELECT query_id FROM exact_q) GROUP BY query_id, doc_id""")
def fast_path(spark, sf_dir):
    """Questions with an exact anchor are answered by the exact and the lexical lane; the vectors are searched for the others alone."""
    found = plan.exact_and_lexical(spark, sf_dir)
    anchored = found["exact"].select("query_id").distinct()
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    open_ = asked.join(anchored.select((F.col("query_id") * 100).alias("query_id")), "query_id", "left_anti")
    dense = retrieval.dense(v, open_).withColumn("query_id", F.expr("query_id div 100"))
    fused = fusion.fuse(fusion.union_lanes(found | {"dense": dense}))
    return fused.join(anchored.withColumn("fast", F.lit(True)), "query_id", "left").withColumn("fast", F.coalesce("fast", F.lit(False)))


METADATA = """hint AS (SELECT l.query_id, d.source, d.lang FROM lexical l JOIN documents d USING (doc_id) WHERE l.rank = 1),
meta AS (SELECT * FROM (SELECT h.query_id, d.doc_id, row_number() OVER (PARTITION BY h.query_id ORDER BY CASE WHEN d.lang = h.lang THEN 2 ELSE 1 END DESC, d.doc_id) AS rank FROM hint h JOIN documents d ON d.source = h.source) WHERE rank <= 8)"""


@query(f"""WITH {plan.LANES}, {METADATA} SELECT query_id::BIGINT AS query_id, doc_id, {SCORE} FROM (SELECT * FROM u UNION ALL SELECT query_id, doc_id, rank, 'metadata' FROM meta) GROUP BY query_id, doc_id""")
def metadata_fusion(spark, sf_dir):
    """All four lanes: a question's source and language are those of its best lexical hit."""
    found = plan.all_lanes(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    hint = found["lexical"].filter("rank = 1").select("query_id", "doc_id").join(docs, "doc_id").drop("doc_id")
    return fusion.fuse(fusion.union_lanes(found | {"metadata": retrieval.metadata(docs, hint)}))


@query(rf"""WITH {plan.LANES}, {plan.CONTENT}, {plan.CHUNK_HITS}, o AS (SELECT h.query_id, h.doc_id, h.chunk_index, len(regexp_extract_all(lower('検索文書: ' || c.chunk), '[\p{{L}}\p{{N}}]+'))::BIGINT AS tokens, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank, h.chunk_index) AS rank FROM capped h JOIN c ON c.doc_id = h.doc_id AND c.chunk_index = h.chunk_index)
SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM o) WHERE used <= 1500""")
def token_pack(spark, sf_dir):
    """Evidence in order while its tokens, those of the prefix included, fit the budget."""
    found = written(plan.chunk_hits(spark, sf_dir), "chunk-hits")
    chunks = chunking.chunks(plan.documents_of(spark, sf_dir, found)).select("doc_id", "chunk_index", F.size(T.tokens(F.concat(F.lit(T.DOCUMENT_PREFIX), "chunk"))).cast("long").alias("tokens"))
    w = Window.partitionBy("query_id").orderBy("rank", "chunk_index")
    rows = found.join(chunks, ["doc_id", "chunk_index"]).select("query_id", "doc_id", "chunk_index", "tokens", F.row_number().over(w).cast("long").alias("rank"))
    return fusion.pack(rows, 1500, "tokens")


@query(f"""WITH {plan.LANES}, {plan.CONTENT}, {plan.CHUNK_HITS}, {plan.PACKED},
near AS (SELECT h.query_id, h.doc_id, c.chunk_index, CASE WHEN min(h.chunk_index) > c.chunk_index THEN 'context_before' WHEN max(h.chunk_index) < c.chunk_index THEN 'context_after' ELSE 'context_between' END AS role FROM packed h JOIN c ON c.doc_id = h.doc_id AND abs(c.chunk_index - h.chunk_index) = 1
  WHERE NOT EXISTS (SELECT 1 FROM packed x WHERE x.query_id = h.query_id AND x.doc_id = h.doc_id AND x.chunk_index = c.chunk_index) GROUP BY h.query_id, h.doc_id, c.chunk_index),
g AS (SELECT query_id, 'E' AS part, doc_id, chunk_index, 'matched' AS role, rank AS place FROM packed UNION ALL SELECT query_id, 'B', doc_id, chunk_index, role, 0 FROM near UNION ALL SELECT query_id, 'D', doc_id, NULL, 'document', min(rank) FROM packed GROUP BY query_id, doc_id)
SELECT query_id, part || row_number() OVER (PARTITION BY query_id, part ORDER BY place, doc_id, chunk_index) AS label, doc_id, chunk_index, role FROM g""")
def answer_groups(spark, sf_dir):
    """Evidence E, background B (neighbours, before or after what they are next to) and document results D, each numbered by itself."""
    packed = plan.evidence(spark, sf_dir)
    near = fusion.neighbours(packed, features.chunk_rows(spark, sf_dir)).groupBy("query_id", "doc_id", "chunk_index").agg(F.min("hit_index").alias("low"), F.max("hit_index").alias("high"))
    side = F.when(F.col("low") > F.col("chunk_index"), "context_before").when(F.col("high") < F.col("chunk_index"), "context_after").otherwise("context_between")
    row = lambda df, part, role, place, chunk="chunk_index": df.select("query_id", F.lit(part).alias("part"), "doc_id", (F.col(chunk) if chunk else F.lit(None)).cast("long").alias("chunk_index"), role.alias("role"), place.cast("long").alias("place"))
    documents = packed.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    rows = row(packed, "E", F.lit("matched"), F.col("rank")).unionByName(row(near, "B", side, F.lit(0))).unionByName(row(documents, "D", F.lit("document"), F.col("rank"), None))
    w = Window.partitionBy("query_id", "part").orderBy("place", "doc_id", "chunk_index")
    return rows.select("query_id", F.concat("part", F.row_number().over(w).cast("string")).alias("label"), "doc_id", "chunk_index", "role")


@query(f"""WITH {plan.LANES}, h AS (SELECT query_id // 3 AS chat, query_id, doc_id FROM ranked WHERE rank <= 8), fresh AS (SELECT chat, doc_id, min(query_id) AS query_id FROM h GROUP BY chat, doc_id),
views AS (SELECT v.chat, v.query_id, count(x.doc_id) AS new_docs FROM (SELECT DISTINCT chat, query_id FROM h) v LEFT JOIN fresh x USING (chat, query_id) GROUP BY v.chat, v.query_id)
SELECT chat::BIGINT AS chat, query_id, new_docs, coalesce(sum(new_docs) OVER (PARTITION BY chat ORDER BY query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 10 AS ran FROM views""")
def view_cap(spark, sf_dir):
    """Views of one need in turn, until ten documents are found: later ones do not run."""
    h = plan.hits(spark, sf_dir).filter("rank <= 8").select(F.expr("query_id div 3").alias("chat"), "query_id", "doc_id")
    new = h.groupBy("chat", "doc_id").agg(F.min("query_id").alias("query_id")).groupBy("chat", "query_id").agg(F.count("*").alias("new_docs"))
    views = h.select("chat", "query_id").distinct().join(new, ["chat", "query_id"], "left").withColumn("new_docs", F.coalesce("new_docs", F.lit(0)).cast("long"))
    before = F.coalesce(F.sum("new_docs").over(Window.partitionBy("chat").orderBy("query_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return views.withColumn("ran", before < 10)


@query(f"""WITH {features.BM25}, h AS (SELECT query_id // 4 AS chat, query_id, doc_id FROM lexical), v AS (SELECT item_id // 4 AS chat, item_id AS query_id FROM benchmark), fresh AS (SELECT chat, doc_id, min(query_id) AS query_id FROM h GROUP BY chat, doc_id),
n AS (SELECT v.chat, v.query_id, count(x.doc_id) AS new_docs FROM v LEFT JOIN fresh x USING (chat, query_id) GROUP BY v.chat, v.query_id),
r AS (SELECT *, coalesce(sum(new_docs) OVER (PARTITION BY chat ORDER BY query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 14 AS ran FROM n) SELECT chat::BIGINT AS chat, query_id, new_docs FROM r WHERE ran""")
def view_rounds(spark, sf_dir):
    """Four questions are views of one need; those after the fourteenth document are not searched."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    views = features.questions(spark, sf_dir).select(F.expr("query_id div 4").alias("chat"), "query_id", "text")
    return fusion.views_until(views, lambda due: retrieval.lexical(docs, due.select("query_id", "text")), 14)


@query(f"""WITH {plan.LANES} SELECT query_id, rank, source || '/' || doc_id || '.txt' AS file, sha256(split_part(text, chr(10), 1)) AS section_sha, signals, doc_id || '|' || lang AS shown FROM ranked JOIN documents USING (doc_id) WHERE rank <= 8""")
def row_summary(spark, sf_dir):
    """What a report shows of each of the best eight hits."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.element_at(F.split("text", "\n", 2), 1).alias("section"))
    rows = plan.hits(spark, sf_dir).filter("rank <= 8").join(d, "doc_id")
    return rows.select("query_id", "rank", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), T.sha(F.col("section")).alias("section_sha"), "signals", F.concat_ws("|", F.col("doc_id").cast("string"), "lang").alias("shown"))
