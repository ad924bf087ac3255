"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents, in their order, whatever further columns
there are: names that an operator would add stand aside while it runs. Rows may repeat, and rows may share a doc_id but not a text.
An empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, lines, mixing, ngram_join, quality
from corvane.llm.common import documents, materialize

#: The columns that operators read; all others have plain numbered names inside a stage.
READ = ("doc_id", "text", "lang", "source")


def apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs whose further columns can't clash with what operators add, and the selection that gives them their names back."""
    names = [c if c in READ else f"__column_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rules or are outliers of their language and source go.

    Null and empty texts have no words and go; a null language or source is a group of its own; repeated rows share their verdict."""
    plain, back = apart(docs)
    return quality.quality(plain).filter("kept").select(*back)


def keep_first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of repeated line runs, single short lines too, go, and documents that have no word left with them.

    First is the smallest doc_id (null last), then the text's hash, then the row. Texts that had no words, null too, stay as they are; of
    repeated rows one keeps its lines. n_chars, if there, is that of the new text."""
    plain, back = apart(docs)
    out = lines.dedup_lines(plain, min_words=1).filter(~((F.col("lines_removed") > 0) & (F.col("text") == "")))
    out = out.select(*back)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 0.8): one row of each group stays, of its smallest doc_id (null last), then text hash.

    Rows are told apart by doc_id and text, so a text never goes with another one of its id. Of rows that are alike in both, the least
    by its other columns stays. Texts without words, null too, are in no group and stay."""
    plain, back = apart(docs)
    near = materialize(ngram_join.near_documents(plain).filter("n_shingles > 0").select(F.struct("doc_id", "text_key").alias("__key"), "first"), "pipeline-near")
    keys = near.groupBy("__key").agg(F.count("*").alias("__n"), F.first("first").alias("__first")).filter("__n > 1 OR NOT __first")
    keys = materialize(keys, "pipeline-repeats")
    keyed = plain.withColumn("__key", F.struct(F.col("doc_id").cast("long").alias("doc_id"), ngram_join.text_key(F.col("text")).alias("text_key")))
    # Null ids are one id here: keys of structs are compared as values, nulls inside included.
    alone = keyed.join(keys, keyed["__key"].eqNullSafe(keys["__key"]), "left_anti").select(*plain.columns)
    twice = keyed.join(keys.filter("__first"), keyed["__key"].eqNullSafe(keys["__key"]), "left_semi")
    row = F.struct(*plain.columns)
    one = twice.groupBy("__key").agg(F.min_by(row, F.struct(*[F.xxhash64(F.lit(k), F.to_json(row)) for k in (1, 2)])).alias("__row"))
    return alone.unionByName(one.select("__row.*")).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document stands as often as the mix takes it, up to twice.

    Null text has size 0 and goes with its hash's bucket; null sources are one source; repeated rows are taken together."""
    plain, back = apart(docs)
    mixed = mixing.mix(plain)
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: digests of the ids and of what they decode to, one row for each row; null text is the empty text."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", keep_first_lines),
    ("n-gram Jaccard join", keep_one_of_group),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The quality rules' estimates, near-duplicate groups and BPE are beyond SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
