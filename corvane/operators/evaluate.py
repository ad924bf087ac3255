"""Evaluation of two builds or two variants: robust summaries, paired statistics, hashes of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corvane.functions.text import sha
from corvane.sources.work import written

#: A sketch of the values puts two ends around a wanted share of them, so far below and above it; its own error is a fifth of that.
AROUND, ACCURACY = 0.001, 5000
#: So many values of a key at most are ordered without a sketch.
FEW = 10_000


def _key(columns: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns]) if columns else F.struct(F.lit(0).alias("all"))


def ends(values: DataFrame, wanted: dict) -> DataFrame:
    """values(k, v) -> (k, n, t, rank, low, high): for each wanted name its rank, and values that it lies between by a sketch of ranks, whatever
    the spread of the values. NaN stands behind all numbers and is in no sketch."""
    shares = [x for p, _ in wanted.values() for x in (max(0.0, p - AROUND), min(1.0, p + AROUND))]
    number = F.when(~F.isnan("v"), F.col("v"))
    totals = written(values.groupBy("k").agg(F.count("*").alias("n"), F.percentile_approx(number, shares, ACCURACY).alias("cuts")), "order-totals")
    few = (F.col("n") <= FEW) | F.col("cuts").isNull()
    rank = lambda i, t, f: F.struct(F.lit(t).alias("t"), f(F.col("n")).cast("long").alias("rank"), F.when(few, float("-inf")).otherwise(F.get("cuts", F.lit(2 * i))).alias("low"), F.when(few, float("inf")).otherwise(F.get("cuts", F.lit(2 * i + 1))).alias("high"))
    return totals.select("k", "n", F.inline(F.array(*[rank(i, t, f) for i, (t, (_, f)) in enumerate(wanted.items())])))


def near(values: DataFrame, asked: DataFrame) -> DataFrame:
    """(k, t, v, n): equal values between the ends, counted, and one row with a null v for all that lie below them."""
    place = values.alias("x").join(asked.alias("y"), F.col("x.k").eqNullSafe(F.col("y.k"))).filter((F.col("v") <= F.col("high")) | F.isnan("v") & F.isnan("high"))
    return place.groupBy("x.k", "y.t", "y.rank", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))


def order_statistics(rows: DataFrame, keys: list[str], value: str, wanted: dict) -> DataFrame:
    """(keys, n, one column for each wanted name): exact values at 1-based ranks. A wanted name has the share of the values that its rank stands for and
    the rank as a function of their number n.

    No task sees a whole key of more than FEW values: of each rank, the values between two ends, a few thousandths of all, are ordered, and
    the rest is counted. Where a sketch's ends miss a rank, which the counts show, that key is ordered as a whole. Null values do not count."""
    values = written(rows.select(_key(keys).alias("k"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL"), "order-values")
    asked = ends(values, wanted)

    def hits(asked: DataFrame) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy("k", "t").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
        inside = near(values, asked).withColumn("upto", upto).filter("v IS NOT NULL")
        return inside.filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select("k", "t", "v")

    found = written(hits(asked), "order-found")
    missed = asked.alias("x").join(found.alias("y"), F.col("x.k").eqNullSafe(F.col("y.k")) & (F.col("x.t") == F.col("y.t")), "left_anti")
    if missed.limit(1).count():
        found = found.unionByName(hits(missed.withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("nan")))))
    picked = found.groupBy("k").agg(*[F.max(F.when(F.col("t") == t, F.col("v"))).alias(t) for t in wanted])
    totals = asked.select("k", "n").distinct()
    out = totals.alias("x").join(picked.alias("y"), F.col("x.k").eqNullSafe(F.col("y.k")))
    return out.select(*[F.col(f"x.k.{c}").alias(c) for c in keys], "x.n", *[F.col(f"y.{t}") for t in wanted])


#: Ranks of n values: the middle two (one for odd n), and the nearest rank that 95 % do not exceed.
MEDIAN = {"low": (0.5, lambda n: F.floor((n + 1) / 2)), "high": (0.5, lambda n: F.floor(n / 2) + 1)}
P95 = {"p95": (0.95, lambda n: F.floor((n * 95 + 99) / 100))}


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, n, name): the average of the middle two values."""
    return order_statistics(rows, keys, value, MEDIAN).select(*keys, "n", ((F.col("low") + F.col("high")) / 2).alias(name))


def summary(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, n, median, p95) of numeric columns; booleans are no numbers and left out."""
    numeric = [m for m in metrics if not isinstance(rows.schema[m].dataType, BooleanType)]
    long = rows.unpivot(keys, numeric, "metric", "v")
    found = order_statistics(long, [*keys, "metric"], "v", MEDIAN | P95)
    return found.select(*keys, "metric", "n", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), F.round("p95", 6).alias("p95"))


def merkle(rows: DataFrame, key: str, content: str, fan: int = 1000) -> DataFrame:
    """One hash of a table in key order, whatever its partitions: hashes of at most ``fan`` rows at a time, level by level.

    Takes (key, content hash) with distinct non-negative keys; levels are added until one group is left, which takes one look at the
    largest key."""
    level, top = rows.select(F.col(key).alias("k"), F.col(content).alias("h")), rows.agg(F.max(key)).first()[0] or 0
    while True:
        level = level.groupBy(F.floor(F.col("k") / fan).alias("g")).agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("items"))
        level = level.select(F.col("g").alias("k"), sha(F.array_join(F.transform("items", lambda x: x["h"]), "")).alias("h"))
        top //= fan
        if top == 0:
            return level.select(F.col("h").alias("table_sha"))


def list_distance(a: DataFrame, b: DataFrame, k: int, p: float = 0.9) -> DataFrame:
    """How far two builds' result lists (query_id, rank, doc_id) of at most k rows are apart, per question of either: common, the number of documents in
    both; rbo, the rank-biased overlap carried on beyond the longer list (1 for equal lists, 0 for lists without a common document); footrule,
    the sum of distances of ranks over its largest value, an absent document standing one place behind the longer list.

    A document that both lists have by depth m counts at every depth from m on, so its weight is a difference of two sums over depths, and lists are
    joined once."""
    sums = [0.0]
    for d in range(1, k + 1):
        sums.append(sums[-1] + p**d / d)
    met = a.select("query_id", "doc_id", F.col("rank").alias("x")).join(b.select("query_id", "doc_id", F.col("rank").alias("y")), ["query_id", "doc_id"], "full")
    depth = met.groupBy("query_id").agg(F.greatest(F.max("x"), F.max("y")).cast("int").alias("depth"))
    upto = F.array(*[F.lit(x) for x in sums])
    weight = (1 - p) / p * (F.get(upto, F.col("depth")) - F.get(upto, F.greatest("x", "y").cast("int") - 1)) + F.pow(F.lit(p), F.col("depth")) / F.col("depth")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    behind = F.col("depth") + 1
    rows = met.join(depth, "query_id").groupBy("query_id").agg(
        F.count_if(both).alias("common"), F.round(F.coalesce(F.sum(F.when(both, weight)), F.lit(0.0)), 6).alias("rbo"),
        F.round(F.sum(F.abs(F.coalesce("x", behind) - F.coalesce("y", behind))) / (F.max("depth") * (F.max("depth") + 1)), 6).alias("footrule"),
    )
    return rows.withColumn("equal", F.col("footrule") == 0)
