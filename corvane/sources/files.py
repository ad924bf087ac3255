"""Plain files to text, sections and requests, in parallel over a binaryFile scan: what is no strict UTF-8 is an error row, never a
guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.sources.work import written

TEXT_SUFFIXES = (".txt", ".md", ".pu", ".puml", ".plantuml", ".py", ".yaml")
MAX_LINE = 1 << 20


def listed(spark: SparkSession, root: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES, recursive: bool = True) -> DataFrame:
    """(path, length, modified) of the files below root, or of its direct children; contents are not read."""
    files = _scan(spark, root, recursive)
    return files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes)).select("path", "length", F.col("modificationTime").alias("modified"))


def _scan(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)


def texts(spark: SparkSession, root: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES, recursive: bool = True) -> DataFrame:
    """(path, text, error): line ends become LF; a file that is no UTF-8 has its error and no text."""
    files = _scan(spark, root, recursive).filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(good, F.regexp_replace(F.col("content").cast("string"), "\r\n|\r", "\n")).alias("text"), F.when(~good, "not_utf8").alias("error"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """(path, place, title, text): a heading begins a section; what stands before the first has an empty title, blank sections are left out."""
    parts = F.split(F.concat(F.lit("\n"), "text"), r"\n(?=#{1,6} )")
    rows = files.filter("text IS NOT NULL").select("path", F.posexplode(parts).alias("place", "part"))
    head = F.regexp_extract("part", r"\A#{1,6} ([^\n]*)", 1)
    body = F.trim(F.regexp_replace("part", r"\A#{1,6} [^\n]*\n?", ""))
    out = rows.select("path", "place", F.trim(head).alias("title"), F.regexp_replace(body, r"\A\n+|\n+\z", "").alias("text"))
    return out.filter((F.col("title") != "") | (F.trim("text") != ""))


def line_code(line: Column) -> Column:
    """What a request line is: ok for a JSON object, invalid_request for other JSON; a parse_error is no JSON, no strict UTF-8 or, with its line feed, longer
    than MAX_LINE. A key that stands twice in an object is no JSON here."""
    kind = F.schema_of_variant(parsed(F.when(F.is_valid_utf8(line) & (F.octet_length(line) < MAX_LINE), line)))
    return F.when(kind.isNull(), "parse_error").when(F.startswith(kind, F.lit("OBJECT")), "ok").otherwise("invalid_request")


def parsed(line: Column) -> Column:
    """The whole line as a variant, null if it is no JSON. Spark's parser stops after the first value and ignores what follows, so the line is parsed as
    the first of two array elements, whose second is a hash of the line, which the line itself can't bring."""
    end = F.md5(line.cast("binary"))
    pair = F.try_parse_json(F.concat(F.lit("["), line, F.lit(',"'), end, F.lit('"]')))
    return F.when(F.try_variant_get(pair, "$[1]", "string") == end, F.try_variant_get(pair, "$[0]", "variant"))


def requests(spark: SparkSession, root: str) -> DataFrame:
    """(path, line, bytes, code, request) of the files below root: one JSON object on each line, which a line feed ends; request is the object in compact form,
    keys in order. Whatever breaks a rule is an error of its own, and the next line is read as if nothing had happened; a last line without a line
    feed is a parse_error.

    Files are split like other texts: a large one is many tasks, and only counts of their splits meet, to number the lines."""
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    rows = raw.select(at.alias("at"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("id"), F.octet_length("value").cast("long").alias("bytes"), line_code(F.col("value")).alias("code"), F.to_json(parsed(F.when(F.is_valid_utf8("value"), F.col("value")))).alias("request"))
    rows = written(rows, "request-lines")
    # Lines of a split have numbers in a row, in the order of the file; a file that ends with a line feed has as many bytes as its lines and their ends.
    splits = rows.groupBy("at").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum(F.col("bytes") + 1).alias("bytes"), F.max("size").alias("size"))
    file, order = Window.partitionBy("at.path"), Window.partitionBy("at.path").orderBy("at.start")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("at").alias("of"), F.col("first"), before.alias("before"), F.sum("n").over(file).alias("total"), (F.sum("bytes").over(file) > F.col("size")).alias("open"))
    out = rows.join(splits, F.col("at") == F.col("of")).withColumn("line", F.col("before") + F.col("id") - F.col("first"))
    code = F.when(F.col("open") & (F.col("line") == F.col("total") - 1), "parse_error").otherwise(F.col("code"))
    out = out.select(F.col("at.path").alias("path"), "line", "bytes", code.alias("code"), "request")
    return out.withColumn("request", F.when(F.col("code") != "parse_error", F.col("request")))
