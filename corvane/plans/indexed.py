"""Retrieval over stored indexes: the same answers as the lanes that read all documents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corvane.operators import ann, evaluate, inverted, lanes, lsa
from corvane.plans.base import query
from corvane.plans.features import BM25, questions
from corvane.plans.lanes import DENSE
from corvane.sources.tables import table
from corvane.sources.work import folder


@query(f"WITH {BM25} SELECT query_id, rank, doc_id, score FROM lexical")
def bm25_index_topk(spark, sf_dir):
    """BM25 over an inverted index of all documents, stored in blocks that know their largest score."""
    path = folder(spark, "inverted")
    inverted.build(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return inverted.search(spark, path, questions(spark, sf_dir))[0]


@query(f"WITH {DENSE} SELECT query_id, rank, doc_id, score FROM dense")
def dense_index_topk(spark, sf_dir):
    """The exact answers of a quantised index: cells and codes rule out what cannot be among the best, cosines decide the rest."""
    path = folder(spark, "vectors")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ann.build(v, path, parts=32)  # codes that are near enough to rule out most rows
    return ann.search(spark, path, v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding"), 8, exact=True)


#: The same search over a build without every seventeenth document.
CHANGED = BM25
for _name in ("q", "d", "s", "t", "f", "cand", "lexical"):
    CHANGED = re.sub(rf"(?m)^{_name} AS", f"{_name}2 AS", CHANGED)
    CHANGED = re.sub(rf"\b(FROM|JOIN) {_name}\b", rf"\1 {_name}2", CHANGED)
CHANGED = CHANGED.replace("FROM documents", "FROM documents WHERE doc_id % 17 <> 0").replace(", s GROUP BY", ", s2 GROUP BY")
P = 0.9


@query(f"""WITH {BM25}, {CHANGED}, m AS (SELECT query_id, doc_id, a.rank AS x, b.rank AS y FROM lexical a FULL JOIN lexical2 b USING (query_id, doc_id)), n AS (SELECT query_id, greatest(max(x), max(y)) AS depth FROM m GROUP BY query_id),
w AS (SELECT m.*, depth, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN (1 - {P}::DOUBLE) / {P}::DOUBLE * list_sum(list_transform(range(greatest(x, y), depth + 1), lambda d: pow({P}::DOUBLE, d) / d)) + pow({P}::DOUBLE, depth) / depth END AS weight FROM m JOIN n USING (query_id))
SELECT query_id, count(weight) AS common, round(coalesce(sum(weight), 0), 6) AS rbo, round(sum(abs(coalesce(x, depth + 1) - coalesce(y, depth + 1)))::DOUBLE / (max(depth) * (max(depth) + 1)), 6) AS footrule, sum(abs(coalesce(x, depth + 1) - coalesce(y, depth + 1))) = 0 AS equal FROM w GROUP BY query_id""")
def retrieval_equality(spark, sf_dir):
    """The best eight of each question in two builds: all documents, and those of which every seventeenth is gone."""
    docs, asked = table(spark, sf_dir, "documents").select("doc_id", "text"), questions(spark, sf_dir)
    return evaluate.list_distance(lanes.lexical(docs, asked), lanes.lexical(docs.filter("doc_id % 17 != 0"), asked), 8, P)


@query()
def semantic_topk(spark, sf_dir):
    """The best eight documents of each question by vectors that come from the texts themselves; SQL has no such decomposition."""
    lists = lsa.listed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = lsa.fit_lists(lists)
    found = lsa.vectors_of(lists, model).withColumnRenamed("doc_id", "vec_id")
    # A row is no answer to the question of its own id: questions have ids of their own here.
    asked = lsa.vectors(questions(spark, sf_dir).withColumn("query_id", -1 - F.col("query_id")), model, "query_id")
    return lanes.dense(found, asked).withColumn("query_id", -1 - F.col("query_id"))
