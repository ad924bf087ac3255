"""Writers. A collection is a folder of versions; its manifest names the current one and is written last, so a
reader sees either the old version or the whole new one, and a rerun after a failure leaves nothing half done."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(root: str, version: str, tables: dict[str, DataFrame], manifest: dict) -> None:
    """Writes every table below root/version, checks counts against the manifest's record_count, then the manifest."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    counts = {name: spark.read.parquet(f"{root}/{version}/{name}").count() for name in tables}
    want = manifest.get("record_count")
    if want is not None and any(n != want for n in counts.values()):
        raise ValueError(f"tables have {counts} rows, the manifest says {want}")
    fs, path = _fs(spark, f"{root}/manifest.json")
    out = fs.create(path, True)
    try:
        out.write(bytearray(json.dumps(manifest | {"version": version, "counts": counts}, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def manifest(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{root}/manifest.json", wholetext=True).first()[0])


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{manifest(spark, root)['version']}/{name}")


def write_clean(records: DataFrame, path: str) -> None:
    """Clean records as JSON lines: the source that every index can be rebuilt from."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_bundle(results: DataFrame, path: str) -> None:
    """Result sets, a folder for each."""
    results.write.mode("overwrite").partitionBy("result_set_id").json(path)


def as_prompt(evidence: DataFrame) -> DataFrame:
    """(label, doc_id, excerpt) as lines of a prompt."""
    return evidence.select(F.format_string("[%s] (%s) %s", "label", F.col("doc_id").cast("string"), "excerpt").alias("line"))


def append_events(events: DataFrame, path: str) -> None:
    """An event log as JSON lines that is only ever added to."""
    events.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """A report as UTF-8 JSON with an indent of two, in whatever store the path is of; it has its name once it is whole."""
    fs, part = _fs(spark, f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(f"{json.dumps(report, ensure_ascii=False, indent=2)}\n".encode()))
    finally:
        out.close()
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), False)
    fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(path))


def deliver(results: DataFrame, how: str, kind: str, path: str | None = None) -> DataFrame | None:
    """Rows (label, doc_id, excerpt) as json, prompt or text: to a file's folder, or returned as lines to be printed."""
    shapes = {"json": lambda: results.select(F.to_json(F.struct("*")).alias("line")), "prompt": lambda: as_prompt(results), "text": lambda: results.select(F.col("excerpt").alias("line"))}
    if kind not in shapes or how not in ("stdout", "file"):
        raise ValueError("json, prompt or text to stdout or file")
    if how == "stdout":
        return shapes[kind]()
    shapes[kind]().write.mode("overwrite").text(path)
    return None
