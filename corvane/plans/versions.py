"""A stored collection of documents and vectors through its versions: made, changed twice, compacted, changed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.base import query
from corvane.sources import collection
from corvane.sources.tables import table
from corvane.sources.work import folder

LATER = 1_000_000_000


def stored(spark, sf_dir) -> str:
    """Version 2 edits every tenth document and deletes every seventeenth with its vector; 3 adds documents and turns vectors round; 4 is compacted; 5 edits
    every hundredth, which brings back some that were deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    root = folder(spark, "collection")
    dead = F.col("doc_id") % 17 == 0
    collection.create(spark, root, {"catalog": docs, "vectors": vectors}, "doc_id", buckets=16)
    edited = docs.filter((F.col("doc_id") % 10 == 0) & ~dead).withColumn("text", F.concat("text", F.lit(" edited")))
    collection.upsert(spark, root, {"catalog": edited}, docs.filter(dead).select("doc_id").unionByName(vectors.filter(dead).select("doc_id")))
    added = docs.filter("doc_id % 50 = 7").withColumn("doc_id", F.col("doc_id") + LATER)
    turned = vectors.filter((F.col("doc_id") % 50 == 7) & ~dead).withColumn("embedding", F.transform("embedding", lambda x: -x))
    collection.upsert(spark, root, {"catalog": added, "vectors": turned})
    collection.compact(spark, root, parts=1)
    collection.upsert(spark, root, {"catalog": docs.filter("doc_id % 100 = 0").withColumn("text", F.concat("text", F.lit(" again")))})
    return root


@query(f"""WITH v2 AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN text || ' edited' ELSE text END AS text FROM documents WHERE doc_id % 17 <> 0),
v5 AS (SELECT * FROM v2 WHERE doc_id % 100 <> 0 UNION ALL SELECT doc_id + {LATER}, source, text FROM documents WHERE doc_id % 50 = 7 UNION ALL SELECT doc_id, source, text || ' again' FROM documents WHERE doc_id % 100 = 0)
SELECT 2 AS version, doc_id, source, sha256(text) AS sha FROM v2 UNION ALL SELECT 5, doc_id, source, sha256(text) FROM v5""")
def collection_versions(spark, sf_dir):
    """The last version and, as it was, the second one."""
    root = stored(spark, sf_dir)
    rows = [collection.read(spark, root, "catalog", v).select(F.lit(v).alias("version"), "doc_id", "source", T.sha(F.col("text")).alias("sha")) for v in (2, 5)]
    return rows[0].unionByName(rows[1])


@query("""WITH d AS (SELECT doc_id, doc_id % 10 = 0 AS ten, doc_id % 17 = 0 AS dead, doc_id % 50 = 7 AS more, doc_id % 100 = 0 AS again FROM documents), v AS (SELECT vec_id, vec_id % 17 = 0 AS dead, vec_id % 50 = 7 AS more FROM embeddings),
c(version, action, name, written, deleted) AS (SELECT 1, 'create', 'catalog', count(*), 0 FROM d UNION ALL SELECT 1, 'create', 'vectors', count(*), 0 FROM v
  UNION ALL SELECT 2, 'upsert', 'catalog', count(*) FILTER (ten AND NOT dead), count(*) FILTER (ten OR dead) FROM d UNION ALL SELECT 2, 'upsert', 'vectors', 0, count(*) FILTER (dead) FROM v
  UNION ALL SELECT 3, 'upsert', 'catalog', count(*) FILTER (more), 0 FROM d UNION ALL SELECT 3, 'upsert', 'vectors', count(*) FILTER (more AND NOT dead), count(*) FILTER (more AND NOT dead) FROM v
  UNION ALL SELECT 5, 'upsert', 'catalog', count(*) FILTER (again), count(*) FILTER (again AND NOT dead) FROM d UNION ALL SELECT 5, 'upsert', 'vectors', 0, 0),
r AS (SELECT *, sum(written - deleted) OVER (PARTITION BY name ORDER BY version)::BIGINT AS rows FROM c)
SELECT version, action, name, written, deleted, rows FROM r UNION ALL SELECT 4, 'compact', name, rows, 0, rows FROM r WHERE version = 3""")
def collection_history(spark, sf_dir):
    """What each version wrote and deleted, table by table, as its manifest has it."""
    return collection.history(spark, stored(spark, sf_dir)).drop("read")
