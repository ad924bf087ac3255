"""Keeping a collection in step with its sources: keys and hashes decide, no row is looked at one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T


def difference(old: DataFrame, new: DataFrame, key: str = "doc_id", content: str = "sha") -> DataFrame:
    """(key, change): ADD, UPDATE, SAME or MISSING."""
    o, n = old.select(F.col(key), F.col(content).alias("was")), new.select(F.col(key), F.col(content).alias("now"))
    change = F.when(F.col("was").isNull(), "ADD").when(F.col("now").isNull(), "MISSING").when(F.col("was") == F.col("now"), "SAME").otherwise("UPDATE")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def upsert(old: DataFrame, changed: DataFrame, deleted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Old rows that are neither replaced nor deleted, and the new ones: one anti-join and a union."""
    gone = changed.select(key).unionByName(deleted.select(key))
    return old.join(gone, key, "left_anti").unionByName(changed)


def orphans(children: DataFrame, parents: DataFrame, key: str = "doc_id") -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def integrity(catalog: DataFrame, vectors: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: the counts of three stored tables, what has no partner, and whether all agree."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    row = one(catalog, "catalog_rows").crossJoin(one(vectors, "vector_rows")).crossJoin(one(manifest, "manifest_rows"))
    for name, children, parents in (("orphan_vectors", vectors, catalog), ("orphan_labels", manifest, catalog), ("without_vector", catalog, vectors)):
        row = row.crossJoin(one(orphans(children.select(key), parents, key), name))
    n = F.col("catalog_rows")
    return row.withColumn("passes", (n == F.col("vector_rows")) & (n == F.col("manifest_rows")) & (F.col("orphan_vectors") == 0) & (F.col("orphan_labels") == 0) & (F.col("without_vector") == 0))


def selected(path: Column, suffixes: tuple[str, ...], recursive: bool = True) -> Column:
    """Whether a path relative to its root belongs to a profile, and to the root itself if not recursive."""
    mine = T.suffix(path).isin(*suffixes)
    return mine if recursive else mine & ~F.contains(path, F.lit("/"))


def flushes(rows: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """rows with the number of their flush: ``size`` at a time, in order, within a group. Places are counted by range of the key first, so
    a hot group is many windows; keys are whole numbers and distinct in a group."""
    span = 1 << 16
    part = F.floor(F.col(key) / span)
    sizes = rows.groupBy(group, part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select(F.col(group).alias("of"), F.col("part").alias("at"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(key)) - 1
    placed = rows.withColumn("part", part).withColumn("place", place)
    joined = placed.join(bases, F.col("of").eqNullSafe(F.col(group)) & (F.col("at") == F.col("part")))
    return joined.withColumn("flush", F.floor((F.col("place") + F.col("before")) / size)).drop("part", "place", "of", "at", "before")


def matches(expected: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, outcome): exactly_one, missing, or repeated if it is expected or met more than once."""
    want, have = expected.groupBy(key).agg(F.count("*").alias("asked")), rows.groupBy(key).agg(F.count("*").alias("met"))
    n = F.coalesce("met", F.lit(0))
    return want.join(have, key, "left").select(key, F.when(n == 0, "missing").when((n > 1) | (F.col("asked") > 1), "repeated").otherwise("exactly_one").alias("outcome"))
