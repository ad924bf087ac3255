"""M3: the four retrieval lanes and the scans and filters around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import features, lanes
from corvane.plans.base import query
from corvane.plans.features import IDENTIFIERS
from corvane.sources.tables import table

#: Questions of the dense lane: every vector whose id is divisible by 100, against all vectors.
NORM = "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))"
DENSE = f"""
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, {NORM} AS n FROM embeddings),
dense AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 8)
"""
#: Questions of the exact lane: every identifier that occurs, and two that don't.
EXACT = f"""
{IDENTIFIERS},
eq AS (SELECT DISTINCT sha256(identifier) AS query_id, identifier FROM p UNION ALL SELECT sha256(x), x FROM (VALUES ('RFC999999'), ('catalog-guide-99.docx')) t(x)),
exact AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (
  SELECT query_id, doc_id, sum(n)::DOUBLE AS score FROM eq JOIN p USING (identifier) GROUP BY ALL)) WHERE rank <= 8)
"""
ABSENT = ("RFC999999", "catalog-guide-99.docx")


def dense(spark, sf_dir, k: int = 8):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return lanes.dense(v, v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding"), k)


def identifier_table(spark, sf_dir):
    return features.identifiers(table(spark, sf_dir, "documents").select("doc_id", "text"))


def exact(spark, sf_dir):
    p = identifier_table(spark, sf_dir)
    asked = p.select("identifier").distinct().unionByName(spark.createDataFrame([(x,) for x in ABSENT], "identifier string"))
    return lanes.exact(p, asked.select(T.sha(F.col("identifier")).alias("query_id"), "identifier"))


@query(f"WITH {DENSE} SELECT * FROM dense")
def dense_topk(spark, sf_dir):
    return dense(spark, sf_dir)


@query(f"WITH {EXACT} SELECT * FROM exact")
def exact_lookup(spark, sf_dir):
    return exact(spark, sf_dir)


@query(f"WITH {IDENTIFIERS} SELECT x AS anchor, (SELECT count(*) FROM p WHERE identifier = x) AS exact_rows, (SELECT count(*) FROM p WHERE identifier = x) = 0 AS passes FROM (VALUES ('RFC999999'), ('catalog-guide-99.docx')) t(x)")
def false_anchor(spark, sf_dir):
    p = identifier_table(spark, sf_dir)
    anchors = spark.createDataFrame([(x,) for x in ABSENT], "anchor string")
    found = p.join(anchors, p["identifier"] == anchors["anchor"], "left_semi").groupBy("identifier").agg(F.count("*").alias("found"))
    rows = F.coalesce("found", F.lit(0))
    return anchors.join(found, F.col("identifier") == F.col("anchor"), "left").select("anchor", rows.alias("exact_rows"), (rows == 0).alias("passes"))


METADATA = """metadata AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (
  SELECT q.source || '/' || q.lang AS query_id, d.doc_id, (1 + CASE WHEN d.lang = q.lang THEN 1 ELSE 0 END)::DOUBLE AS score
  FROM (SELECT DISTINCT source, lang FROM documents) q JOIN documents d ON d.source = q.source)) WHERE rank <= 8)"""


@query(f"WITH {METADATA} SELECT * FROM metadata")
def metadata_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    asked = docs.select("source", "lang").distinct().withColumn("query_id", F.concat_ws("/", "source", "lang"))
    return lanes.metadata(docs, asked)


@query(r"""WITH u AS (SELECT strlen(html) AS bytes, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '^[^/]*/', '') AS path FROM pages)
SELECT regexp_matches(path, '^(fr/.*|[^/]*/[^/]*\.html)$') AS excluded, count(*) AS files, sum(bytes)::BIGINT AS bytes, bool_and(starts_with(path, 'fr/') OR starts_with(path, 'en/') OR starts_with(path, 'de/') OR starts_with(path, 'es/')) AS contained FROM u GROUP BY 1""")
def url_exclusion_preview(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", ""), r"^[^/]*/", "")
    excluded = path.rlike(T.glob_regex("fr/**")) | path.rlike(T.glob_regex("*/*.html"))
    inside = path.startswith("fr/") | path.startswith("en/") | path.startswith("de/") | path.startswith("es/")
    pages = table(spark, sf_dir, "pages").select(excluded.alias("excluded"), F.octet_length("html").cast("long").alias("bytes"), inside.alias("inside"))
    return pages.groupBy("excluded").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.bool_and("inside").alias("contained"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (contains(props, '"k": 1')) AS marked FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND event_type IN ('click', 'view', 'error') GROUP BY event_type""")
def source_filter(spark, sf_dir):
    """The cutoff and the set of kinds reach the Parquet scan as pushed filters."""
    events = table(spark, sf_dir, "events").filter((F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))) & F.col("event_type").isin("click", "view", "error"))
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.contains("props", F.lit('"k": 1'))).alias("marked"))


@query(f"SELECT vec_id, label, len(embedding)::BIGINT AS dim, round({NORM}, 6) AS norm, round(embedding[1]::DOUBLE, 6) AS head FROM embeddings")
def vector_scan(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.col("embedding")[0].cast("double"), 6).alias("head"))
