"""M6: incremental maintenance over two versions of documents: every tenth edited, every seventeenth removed, some added."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import maintenance
from corvane.plans import features
from corvane.plans.base import query
from corvane.sources.tables import table

VERSIONS = """old AS (SELECT doc_id, source, sha256(text) AS sha FROM documents),
new AS (SELECT doc_id, source, sha256(CASE WHEN doc_id % 10 = 0 THEN text || ' edited' ELSE text END) AS sha FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT doc_id + 1000000000, source, sha256(text) FROM documents WHERE doc_id % 50 = 7),
diff AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.source, n.source) AS source, CASE WHEN o.doc_id IS NULL THEN 'ADD' WHEN n.doc_id IS NULL THEN 'MISSING' WHEN o.sha = n.sha THEN 'SAME' ELSE 'UPDATE' END AS change FROM old o FULL JOIN new n USING (doc_id))"""


def old(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", T.sha(F.col("text")).alias("sha"))


def new(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = d.filter("doc_id % 17 != 0").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    added = d.filter("doc_id % 50 = 7").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    return kept.unionByName(added).select("doc_id", "source", T.sha(F.col("text")).alias("sha"))


def diff(spark, sf_dir):
    return maintenance.difference(old(spark, sf_dir), new(spark, sf_dir))


@query(f"WITH {VERSIONS} SELECT doc_id, change FROM diff")
def incremental_diff(spark, sf_dir):
    return diff(spark, sf_dir)


@query(f"WITH {VERSIONS} SELECT doc_id, source, sha FROM new")
def merge_upsert(spark, sf_dir):
    """The old version with the changes applied is the new one."""
    d = diff(spark, sf_dir)
    changed = new(spark, sf_dir).join(d.filter("change IN ('ADD', 'UPDATE')"), "doc_id", "left_semi")
    return maintenance.upsert(old(spark, sf_dir), changed, d.filter("change = 'MISSING'"))


@query("SELECT source, count(*) FILTER (source NOT IN ('src1', 'src7') AND doc_id % 17 <> 0) AS kept, count(*) FILTER (source IN ('src1', 'src7') OR doc_id % 17 = 0) AS deleted FROM documents GROUP BY source")
def reconcile_deletes(spark, sf_dir):
    """Documents that are indexed and no longer selected go, even when a source keeps none."""
    indexed = table(spark, sf_dir, "documents").select("doc_id", "source")
    selected = indexed.filter(~F.col("source").isin("src1", "src7") & (F.col("doc_id") % 17 != 0)).select("doc_id")
    gone = indexed.join(selected, "doc_id", "left_anti").withColumn("gone", F.lit(1))
    kept = indexed.join(selected, "doc_id", "left_semi").withColumn("gone", F.lit(0))
    return kept.unionByName(gone).groupBy("source").agg(F.sum(1 - F.col("gone")).alias("kept"), F.sum("gone").cast("long").alias("deleted"))


@query(f"""WITH {VERSIONS} SELECT CASE WHEN substr(source, 4)::INT % 2 = 0 THEN 'upsert_only' ELSE 'mirror' END AS policy, count(*) FILTER (change <> 'MISSING' OR substr(source, 4)::INT % 2 = 0) AS rows_after, count(*) FILTER (change = 'MISSING' AND substr(source, 4)::INT % 2 = 1) AS deleted FROM diff GROUP BY 1""")
def retention_policy(spark, sf_dir):
    """Sources that keep what they no longer see, and sources that mirror."""
    sources = old(spark, sf_dir).select("doc_id", "source").unionByName(new(spark, sf_dir).select("doc_id", "source")).distinct()
    policy = F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, "upsert_only").otherwise("mirror")
    rows = diff(spark, sf_dir).join(sources, "doc_id").withColumn("policy", policy)
    keep = (F.col("change") != "MISSING") | (F.col("policy") == "upsert_only")
    return rows.groupBy("policy").agg(F.count_if(keep).alias("rows_after"), F.count_if(~keep).alias("deleted"))


@query("SELECT doc_id, source, sha256(text) AS sha FROM documents WHERE source IN ('src2', 'src3')")
def copy_subset(spark, sf_dir):
    return old(spark, sf_dir).filter(F.col("source").isin("src2", "src3"))


@query("""WITH r AS (SELECT (SELECT count(*) FROM documents) AS catalog_rows, (SELECT count(*) FROM embeddings) AS vector_rows, (SELECT count(*) FROM labels) AS manifest_rows,
(SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS orphan_vectors, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS orphan_labels,
(SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector)
SELECT *, catalog_rows = vector_rows AND vector_rows = manifest_rows AND orphan_vectors = 0 AND orphan_labels = 0 AND without_vector = 0 AS passes FROM r""")
def integrity_check(spark, sf_dir):
    """Three tables that were written apart: documents as the catalog, embeddings as its vectors, labels as its manifest."""
    return maintenance.integrity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), table(spark, sf_dir, "labels"))


@query(f"WITH {features.CHUNKS} SELECT source, count(*) AS records, ceil(count(*) / 8)::BIGINT AS calls_8, ceil(count(*) / 128)::BIGINT AS calls_128, (count(*) % 128)::BIGINT AS last_batch FROM c GROUP BY source")
def flush_plan(spark, sf_dir):
    n = F.count("*")
    return features.chunk_rows(spark, sf_dir).groupBy("source").agg(n.alias("records"), F.ceil(n / 8).alias("calls_8"), F.ceil(n / 128).alias("calls_128"), (n % 128).alias("last_batch"))


@query("WITH p AS (SELECT doc_id FROM documents WHERE doc_id % 10 = 0 UNION SELECT doc_id FROM documents WHERE doc_id % 17 = 0) SELECT source, count(*) AS changed FROM documents WHERE doc_id IN (SELECT doc_id FROM p) GROUP BY source")
def changed_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    paths = d.filter("doc_id % 10 = 0").select("doc_id").union(d.filter("doc_id % 17 = 0").select("doc_id")).distinct()
    return d.join(paths, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("changed"))


@query("""WITH m AS (SELECT count(*) AS record_count, max(len(embedding))::BIGINT AS dimension, count(DISTINCT label) AS labels FROM embeddings)
SELECT key, value, expected, value = expected AS same, bool_and(value = expected) OVER () AS passes FROM (SELECT 'dimension' AS key, dimension AS value, 64 AS expected FROM m UNION ALL SELECT 'labels', labels, 10 FROM m UNION ALL SELECT 'record_count', record_count, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) FROM m)""")
def expected_metadata(spark, sf_dir):
    from pyspark.sql import Window

    m = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("record_count"), F.max(F.size("embedding")).cast("long").alias("dimension"), F.count_distinct("label").alias("labels"))
    # Records are expected to be the documents that have a vector.
    stored = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").agg(F.count("*").alias("stored"))
    m = m.crossJoin(stored)  # one row each
    want = {"dimension": F.lit(64), "labels": F.lit(10), "record_count": F.col("stored")}
    rows = m.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value"), v.cast("int").alias("expected")) for k, v in want.items()])))
    rows = rows.withColumn("expected", F.col("expected").cast("long")).withColumn("same", F.col("value") == F.col("expected"))
    return rows.withColumn("passes", F.bool_and("same").over(Window.partitionBy()))  # three rows


@query(f"WITH {VERSIONS} SELECT source, count(*) FILTER (change IN ('ADD', 'UPDATE')) AS documents, count(*) FILTER (change IN ('ADD', 'UPDATE')) AS least_minutes, 5 * count(*) FILTER (change IN ('ADD', 'UPDATE')) AS most_minutes FROM diff GROUP BY source")
def apply_estimate(spark, sf_dir):
    sources = old(spark, sf_dir).select("doc_id", "source").unionByName(new(spark, sf_dir).select("doc_id", "source")).distinct()
    n = F.count_if(F.col("change").isin("ADD", "UPDATE"))
    return diff(spark, sf_dir).join(sources, "doc_id").groupBy("source").agg(n.alias("documents"), n.alias("least_minutes"), (5 * n).alias("most_minutes"))


@query(f"WITH {features.CHUNKS} SELECT count(*) AS records, 0::BIGINT AS only_left, 0::BIGINT AS only_right, true AS equal FROM c")
def rebuild_equal(spark, sf_dir):
    """Two builds from the same clean records, one of them over other partitions, hold the same rows as often."""
    a = features.chunk_rows(spark, sf_dir).select("doc_id", "chunk_index", T.sha(F.col("chunk")).alias("sha"))
    clean = table(spark, sf_dir, "documents").select("doc_id", "source", "text").repartition(7, "doc_id")
    from corvane.operators.features import chunks

    b = chunks(clean).select("doc_id", "chunk_index", T.sha(F.col("chunk")).alias("sha"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    row = one(a, "records").crossJoin(one(a.exceptAll(b), "only_left")).crossJoin(one(b.exceptAll(a), "only_right"))
    return row.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
