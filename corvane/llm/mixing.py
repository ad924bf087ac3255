"""Operator 1: mixing sources to target weights with nested hash-threshold histograms (DataFrame functions only).

Every document gets a hash. A source that must give more than whole passes over its documents gives the rest by a
threshold on that hash. The threshold comes from a histogram of sizes by (source, hash bucket): buckets are taken
whole while their running total fits, then only the first bucket that does not fit is split into finer buckets, down to
``LEVELS * BITS`` bits of the hash. The one hash that then does not fit is taken too where that comes nearer to the target, so a source
misses it by half of that hash's words at most. Nothing is sorted but histograms; documents are filtered by comparing their hash.

Null text has size 0; null sources are one source, last in the order; documents with one id share a hash, so they are
taken together (a null id hashes the text instead). A source without words has target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize, n_words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BITS, LEVELS = 12, 3
DEPTH = BITS * LEVELS


def hash_bits(doc_id: Column, text: Column) -> Column:
    """The first DEPTH bits of md5, as a long."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, DEPTH // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> the same with weight and target: water is filled by weight up to cap * source_size.

    One row per source goes through one window; the number of sources is that of the corpus's feeds, not of its rows.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), k + 1)
    full = F.lit(float(cap)) * F.col("source_size")
    ranked = totals.withColumn("weight", weight).withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything)).withColumn("full", full)
    # Sources fill up in the order of full / weight: the level is the first at which the rest would not fill up.
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level)
    water = F.max(F.when(F.col("weight") * F.col("level") <= F.col("full"), F.col("level"))).over(everything)
    target = F.least(F.col("full"), F.col("weight") * F.coalesce(F.col("water"), F.max("level").over(everything)))
    return levels.withColumn("water", water).withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target)).select("source", "source_size", "weight", "target")


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: passes (whole copies of every document) and cut (documents with a hash below it give one more)."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("passes", passes).withColumn("need", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("cut", F.lit(0).cast("long"))
    for level in range(LEVELS):
        state = materialize(state, "mix-level")  # a row per source, whose size Spark then knows
        step = DEPTH - BITS * (level + 1)
        inside = sized
        if level:
            edge = state.select("source", F.col("cut").alias("edge"))
            inside = sized.join(edge, sized["source"].eqNullSafe(edge["source"]), "inner").select(sized["source"], "h", "size", "edge")
            inside = inside.filter(F.shiftright("h", step + BITS) == F.shiftright("edge", step + BITS))
        histogram = inside.groupBy("source", F.shiftright("h", step).alias("bucket")).agg(F.sum("size").alias("tokens"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        histogram = histogram.withColumn("upto", F.sum("tokens").over(running))
        joined = state.join(histogram.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source")), "left")
        fits = F.col("upto") <= F.col("need")
        last = F.lit(1 << DEPTH).cast("long") if level == 0 else F.shiftleft(F.shiftright("cut", step + BITS) + 1, step + BITS)
        given = F.coalesce(F.sum(F.when(fits, F.col("tokens"))), F.lit(0))
        edge = F.min(F.when(~fits, F.shiftleft(F.col("bucket"), step)))
        if step == 0:  # the edge is one hash: over by it, or short without it
            over = F.min(F.when(~fits, F.col("upto"))) - F.col("need")
            edge = F.when(over < F.col("need") - given, edge + 1).otherwise(edge)
        state = (
            joined.groupBy("source", "source_size", "target", "passes", "need", "cut")
            .agg(given.alias("given"), edge.alias("edge"))
            .select("source", "source_size", "target", "passes", (F.col("need") - F.col("given")).alias("need"), F.coalesce("edge", last).alias("cut"))
        )
    return state


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """docs with their columns and size, source_size, target, copies (0..cap, how often the mix holds the document), taken.

    Columns of docs that clash with the added ones are replaced.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*added)
    sized = docs.select("source", hash_bits(F.col("doc_id"), F.col("text")).alias("h"), n_words(F.col("text")).alias("size"))
    sized = materialize(sized, "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = materialize(thresholds(sized, source_targets(totals, weights, share, cap)).drop("need"), "mix-cuts")
    cuts = cuts.select(F.struct("*").alias("__mix"))  # one name, whatever the documents' columns are called
    # One row per source: Spark broadcasts it only below its own size threshold, and splits hot sources otherwise.
    out = docs.join(cuts, docs["source"].eqNullSafe(F.col("__mix.source")), "left")
    h = hash_bits(docs["doc_id"], docs["text"])
    out = out.withColumn("size", n_words(docs["text"])).withColumn("copies", F.least(F.lit(cap), F.col("__mix.passes") + F.when(h < F.col("__mix.cut"), 1).otherwise(0)))
    out = out.withColumns({"taken": F.col("copies") * F.col("size"), "source_size": F.col("__mix.source_size"), "target": F.col("__mix.target")})
    return out.select(*docs.columns, *added)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    from corvane.llm.common import documents

    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || coalesce(text, ''))), 1, 9))::BIGINT AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  1.5::DOUBLE * sum(source_size) OVER () AS budget, 2.0::DOUBLE * source_size AS full_size FROM t),
l AS (SELECT *, (budget - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT *, coalesce(max(CASE WHEN weight * level <= full_size THEN level END) OVER (), max(level) OVER ()) AS water FROM l),
g AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(full_size, weight * water) END AS target FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM g),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS need,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, ((passes + CASE WHEN upto <= need OR (upto - own <= need AND upto - need < need - (upto - own)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""
