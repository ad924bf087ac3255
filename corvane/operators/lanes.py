"""Retrieval lanes. Each answers a batch of questions as (query_id, rank, doc_id, score): query_id is part of every key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import blocks, strings

K1, B = 1.2, 0.75


def ranked(scored: DataFrame, k: int, *keys: str) -> DataFrame:
    """The best k of each query; the score is rounded before it orders, so ties go to the smaller id on any plan."""
    order = Window.partitionBy("query_id", *keys).orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def lexical(docs: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """BM25 of every question over all documents, doc_id being a key. Document counts and lengths come from one aggregation each; then blocks
    of documents meet blocks of questions, terms by their 64-bit hashes, and the scores of all pairs stay inside a task (``blocks``)."""
    terms = questions.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    n_blocks, few = blocks.question_blocks(terms.groupBy("query_id").agg(F.count("*").alias("n")))
    tokens = T.tokens(F.col("text"))
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg(F.regexp_count(F.lower("text"), F.lit(T.TOKEN)).cast("long")).alias("avg_dl"))
    asked = terms.select("term").distinct()
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    entry = F.struct("query_id", F.xxhash64("term").alias("term"), idf.alias("idf"))
    sides = weighted.groupBy(blocks.block_of(n_blocks)).agg(F.collect_list(entry).alias("asked"), F.first("avg_dl").alias("avg_dl"))
    rows = docs.select("doc_id", F.transform(tokens, lambda t: F.xxhash64(t)).alias("terms"))
    scored = blocks.meet(rows, sides.drop("block"), few, blocks.bm25_kernel(K1, B), k, _type(docs, "doc_id"), _type(questions, "query_id"))
    return ranked(scored.withColumn("score", F.round("score", 6)), k).select("query_id", "rank", "doc_id", "score")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def dense(vectors: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """Exact cosine in double precision of every question with every vector: a stated set of questions against all rows, block by block.
    Vectors that are null or zero, or have null or non-finite components, or are of another length than the question's, answer nothing."""
    n_blocks, few = blocks.question_blocks(questions.select("query_id", F.coalesce(F.size("embedding"), F.lit(0)).alias("n")))
    sides = questions.filter(F.size("embedding") > 0).groupBy(blocks.block_of(n_blocks)).agg(F.collect_list(F.struct("query_id", "embedding")).alias("asked"))
    rows = vectors.select(F.col("vec_id").alias("doc_id"), "embedding")
    scored = blocks.meet(rows, sides.drop("block"), few, blocks.cosine_kernel, k, _type(vectors, "vec_id"), _type(questions, "query_id"))
    return ranked(scored.withColumn("score", F.round("score", 6)), k).select("query_id", "rank", "doc_id", "score")


def exact(postings: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """Whole identifiers alone; a question whose identifier is absent gives no row."""
    hits = questions.select("query_id", "identifier").join(postings, "identifier").groupBy("query_id", "doc_id").agg(F.sum("n").cast("double").alias("score"))
    return ranked(hits, k).select("query_id", "rank", "doc_id", "score")


def passages(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, doc_id) of all documents that hold a question's whole text, as it is written; blank questions have none."""
    return strings.holders(docs, questions)


def metadata(docs: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """Questions as (query_id, source, lang): how many of the fields a document matches."""
    rows = docs.select("doc_id", F.col("source").alias("s"), F.col("lang").alias("l")).join(questions, F.col("s") == F.col("source"))
    score = (F.lit(1) + F.when(F.col("l") == F.col("lang"), 1).otherwise(0)).cast("double")
    return ranked(rows.select("query_id", "doc_id", score.alias("score")), k).select("query_id", "rank", "doc_id", "score")


def by_fields(postings: DataFrame, asked: DataFrame, k: int = 8) -> DataFrame:
    """Questions as (query_id, field, value): how many of its fields another document has, from an equi-join on field and value."""
    met = postings.join(asked, ["field", "value"]).filter("doc_id != query_id").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))
    return ranked(met, k).select("query_id", "rank", "doc_id", "score")


def of_source(rows: DataFrame, source: str) -> DataFrame:
    """Rows of one source; "any" is all of them, with no filter in the plan."""
    return rows if source == "any" else rows.filter(F.col("source") == source)
