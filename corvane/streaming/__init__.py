"""Structured Streaming forms. Each runs what is there to its end (availableNow) with a checkpoint, so a rerun goes on
where the last one stopped; results are files in the session's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources import files
from corvane.sources.work import folder

MAX_LINE = 1 << 20


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of their files, a few at a time."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads folders: of one file, its folder with a filter on the name.
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    if fs.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def to_end(stream: DataFrame, path: str, batch=None, mode: str = "append") -> None:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    q = (writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", f"{path}/out")).start()
    q.awaitTermination()


def phase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals kept in state; each trigger writes the whole small table as a new version, named by its batch."""
    path = folder(spark, "streams/totals")
    totals = events(spark, sf_dir).groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("seconds"))
    seen = []

    def save(df, batch):
        df.write.mode("overwrite").parquet(f"{path}/v{batch}")
        seen.append(batch)

    to_end(totals, path, save, "complete")
    return spark.read.parquet(f"{path}/v{max(seen)}")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request a line: what is no object or too large gets its code, and the loop goes on."""
    path = folder(spark, "streams/requests")
    # Lines are built from rows many times smaller, in all tasks there may be: a file of one row group would be one task's work.
    e = events(spark, sf_dir).select("event_id", "props").repartition(spark.sparkContext.defaultParallelism)
    # Blanks up to one more than the limit: repeat doubles what it has, rpad would add them one by one.
    blanks = F.repeat(F.lit(" "), MAX_LINE + 1 - F.octet_length("props"))
    line = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("["), "props")).when(F.col("event_id") % 11 == 0, F.concat("props", blanks)).otherwise(F.col("props"))
    e = e.select("event_id", line.alias("line"))
    # What is too large is not parsed.
    short = F.when(F.octet_length("line") <= MAX_LINE, F.col("line"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(files.parsed(F.when(F.is_valid_utf8(short), short))), F.lit("OBJECT")), F.lit(False))
    code = F.when(F.octet_length("line") > MAX_LINE, "too_large").when(~is_object, "invalid_json").otherwise("ok")
    to_end(e.select("event_id", code.alias("code")), path)
    return spark.read.schema("event_id long, code string").parquet(f"{path}/out")


def request_lines(spark: SparkSession, root: str, path: str) -> DataFrame:
    """(code, bytes) of the lines of the files below root, those that have come since the last run on this path too."""
    lines = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true").text(root)
    to_end(lines.select(files.line_code(F.col("value")).alias("code"), F.octet_length("value").cast("long").alias("bytes")), path)
    return spark.read.schema("code string, bytes long").parquet(f"{path}/out")


def warn_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type: state is the least id by key, updates replace what was written before."""
    path = folder(spark, "streams/warnings")
    first = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))

    def save(df, batch):
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/updates/batch={batch}")

    to_end(first, path, save, "update")
    rows = spark.read.schema("user_id long, event_type string, event_id long").parquet(f"{path}/updates")
    return rows.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
