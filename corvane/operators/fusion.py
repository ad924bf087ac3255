"""From ranked lanes to an answer: fusion, suppression, context, budget, labels. Neighbours are context, never hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.work import written

RRF_K = 60
WEIGHTS = {"exact": 3.0, "lexical": 1.0, "dense": 1.0, "metadata": 0.5}
PER_DOCUMENT = 2
RADIUS = 1


def union_lanes(lanes: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in lanes.items():
        one = df.select("query_id", "doc_id", "rank", F.lit(name).alias("lane"))
        out = one if out is None else out.unionByName(one)
    return out


def fuse(lanes: DataFrame, weights: dict[str, float] = WEIGHTS, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score, signals): weighted reciprocal ranks, a union and one aggregation instead of outer joins."""
    weight = F.coalesce(*[F.when(F.col("lane") == n, F.lit(w)) for n, w in weights.items()])
    score = F.round(F.sum(weight / (k + F.col("rank"))), 6)
    return lanes.groupBy("query_id", "doc_id").agg(score.alias("score"), F.concat_ws(",", F.array_sort(F.collect_set("lane"))).alias("signals"))


def order_hits(fused: DataFrame, anchors_first: bool = True) -> DataFrame:
    """Adds rank; hits with an exact signal stand first if asked."""
    anchor = F.when(F.array_contains(F.split("signals", ","), "exact"), 0).otherwise(1) if anchors_first else F.lit(0)
    w = Window.partitionBy("query_id").orderBy(anchor, F.col("score").desc(), "doc_id")
    return fused.withColumn("rank", F.row_number().over(w).cast("long"))


def drop_repeats(hits: DataFrame, content: str = "content") -> DataFrame:
    """The best-ranked hit of each content."""
    w = Window.partitionBy("query_id", content).orderBy("rank", "doc_id")
    return hits.withColumn("copy", F.row_number().over(w)).filter("copy = 1").drop("copy")


def cap_per_document(hits: DataFrame, cap: int = PER_DOCUMENT) -> DataFrame:
    w = Window.partitionBy("query_id", "doc_id").orderBy("rank", "chunk_index")
    return hits.withColumn("of_document", F.row_number().over(w).cast("long")).filter(F.col("of_document") <= cap)


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query_id, doc_id, chunk_index, hit_index) of chunks around hits that aren't hits themselves: an equi-join on the document
    and the index that each offset points to, so no range join is needed."""
    offsets = F.array(*[F.lit(d).cast("long") for d in range(-radius, radius + 1) if d])
    near = hits.select("query_id", "doc_id", F.col("chunk_index").alias("hit_index"), F.explode(offsets).alias("d"))
    near = near.withColumn("chunk_index", F.col("hit_index") + F.col("d")).drop("d").join(chunks.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"])
    return near.join(hits.select("query_id", "doc_id", "chunk_index"), ["query_id", "doc_id", "chunk_index"], "left_anti")


def pack(hits: DataFrame, budget: int, size: str = "chars") -> DataFrame:
    """Hits in order while their running size fits; the first that doesn't ends the answer."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def label(hits: DataFrame, prefix: str = "E") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("label", F.concat(F.lit(prefix), F.row_number().over(w).cast("string")))


def views_until(views: DataFrame, search, cap: int) -> DataFrame:
    """(chat, query_id, new_docs) of the views that were searched. views(chat, query_id, ...) of a chat take their turns by query_id; ``search`` answers a
    turn's views of all chats at once as (query_id, doc_id), and a chat whose views have found ``cap`` documents has no further turn: its views
    are not searched. Turns end with the last chat."""
    turn = F.row_number().over(Window.partitionBy("chat").orderBy("query_id"))
    views = written(views.withColumn("turn", turn), "views")
    found = ran = None
    for k in range(1, (views.agg(F.max("turn")).first()[0] or 0) + 1):
        due = views.filter(F.col("turn") == k)
        if found is not None:
            full = found.groupBy("chat").agg(F.count("*").alias("n")).filter(F.col("n") >= cap)
            due = written(due.join(full, "chat", "left_anti"), "views-due")
            if due.isEmpty():
                break
        hits = search(due).select("query_id", "doc_id").join(due.select("query_id", "chat"), "query_id").select("chat", "query_id", "doc_id")
        new = hits if found is None else hits.join(found, ["chat", "doc_id"], "left_anti")
        new = written(new.select("chat", "query_id", "doc_id"), "views-new")
        counted = due.select("chat", "query_id").join(new.groupBy("query_id").agg(F.count("*").alias("new_docs")), "query_id", "left")
        counted = counted.select("chat", "query_id", F.coalesce("new_docs", F.lit(0)).alias("new_docs"))
        ran = counted if ran is None else ran.unionByName(counted)
        found = new.select("chat", "doc_id") if found is None else found.unionByName(new.select("chat", "doc_id"))
    return views.select("chat", "query_id", F.lit(0).cast("long").alias("new_docs")).limit(0) if ran is None else ran
