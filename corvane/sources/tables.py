"""Tables of a data folder, one Parquet path each; nothing is inferred from their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are long texts: a file of one row group would be one task's work.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in TEXTS:
        return df
    # Only inputs with fewer splits than cores are dealt out, which are small by that; others keep their splits.
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
