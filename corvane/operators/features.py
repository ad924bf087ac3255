"""Features of documents: tokens, chunks, identifiers, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

CHUNK, OVERLAP = 1400, 160


def chunk_starts(length: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """0, size - overlap, ...: no window lies wholly inside the one before; none for an empty text."""
    step = size - overlap
    last = F.when(length <= size, 0).otherwise(F.ceil((length - size) / step))
    return F.when(length > 0, F.sequence(F.lit(0).cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs(doc_id, text, ...) -> their columns without text, chunk_index, start, chunk."""
    step = size - overlap
    rest = [c for c in docs.columns if c != "text"]
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    out = docs.select(*rest, "text", F.explode(chunk_starts(n, size, overlap)).alias("chunk_index"))
    return out.select(*rest, "chunk_index", (F.col("chunk_index") * step).alias("start"), F.substring("text", (F.col("chunk_index") * step + 1).cast("int"), F.lit(size)).alias("chunk"))


def identifiers(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, identifier, n): whole tokens only, as they stand."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), T.find_all(F.col("text"), p).alias("found")) for k, p in T.IDENTIFIERS.items()])
    rows = docs.select("doc_id", F.inline(kinds)).select("doc_id", "kind", F.explode("found").alias("identifier"))
    return rows.groupBy("doc_id", "kind", "identifier").agg(F.count("*").alias("n"))


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf)."""
    rows = docs.select("doc_id", T.tokens(F.col("text")).alias("ts")).select("doc_id", F.size("ts").cast("long").alias("dl"), F.explode("ts").alias("term"))
    return rows.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def html_sections(pages: DataFrame) -> DataFrame:
    """(page_id, title, heading, n_paragraphs, n_links, text_chars) of HTML that no XML parser takes."""
    h = F.regexp_replace("html", r"(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", " ")
    bare = T.collapse(F.regexp_replace(F.regexp_replace(h, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " "))
    return pages.select(
        "page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", r"(?is)<h1>(.*?)</h1>", 1).alias("heading"),
        F.size(T.find_all(F.col("html"), r"<p>")).cast("long").alias("n_paragraphs"), F.size(T.find_all(F.col("html"), r"<a href=")).cast("long").alias("n_links"),
        F.length(bare).cast("long").alias("text_chars"),
    )


def prepared(questions: DataFrame) -> DataFrame:
    """(query_id, text) -> embedding_text with the query prefix, terms and identifiers, each once, of a text whose white space is collapsed."""
    c = T.collapse(F.col("text"))
    found = F.flatten(F.array(*[T.find_all(F.col("text"), p) for p in T.IDENTIFIERS.values()]))
    return questions.select("query_id", F.concat(F.lit(T.QUERY_PREFIX), c).alias("embedding_text"), F.array_distinct(T.tokens(F.col("text"))).alias("terms"), found.alias("identifiers"))


def metadata_postings(files: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, field, value): case-folded values of the named columns; empty ones have no row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f)).alias("value")) for f in fields])
    return files.select("doc_id", F.inline(pairs)).filter("value != ''").distinct()
