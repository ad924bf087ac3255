"""What the operators of this subpackage share: the shared work folder, materialised steps and word splitting."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a longest run of anything but ASCII white space. ``bytes.split()`` cuts UTF-8 in the same places.
WORD = r"[^\x20\x09-\x0D]++"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode,
    and an error on a cluster, whose machines don't share their folders."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, root, True)
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/corvane/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes the steps that this driver has written so far; call it when the results that read them are written."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """df's schema and more columns by name and type."""
    more = T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in columns.items()))
    return T.StructType([*df.schema.fields, *more.fields])


def trim() -> None:
    """Gives freed memory back to the system; Python workers live on between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def lean(run):
    """A function of batches that leaves no freed memory behind in its worker."""

    @functools.wraps(run)
    def outer(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return outer
