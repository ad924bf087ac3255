r"""Operator 5: chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned spans: a turn belongs to the span in which its prefix
sum starts, spans being STRIDE tokens wide, so a window holds at most STRIDE tokens and its last turn. Every window has
the conversation's system turn (if it opens with one), then up to HISTORY tokens of the turns before the span, then the span's own
turns. The loss mask covers assistant texts of the span alone: repeated turns are masked, each target is learnt once.

Prefix sums go over buckets of turns first, so that a conversation with a third of all rows is many groups.

Template: ``<turn role>`` text ``</turn>`` with ``\``, ``<`` and ``[`` in roles and texts written as ``\\``, ``\<`` and
``\[``; so no text can hold a control string, and removing the escapes gives the text back.

Null text and null role are empty, null turns come first, turns with one number are ordered by role and text, a null
conv_id is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import lean, materialize, n_words

STRIDE, HISTORY = 1024, 256
TURN_TOKENS = 4  # of the template around a turn
BUCKET = 256
OPEN, CLOSE = "<turn ", "</turn>\n"
TURN = re.compile(r"<turn ((?:[^\\<>]|\\.|\\>)*)>((?:[^\\<]|\\.)*)</turn>\n", re.S)


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\<\[>])", r"\\$1")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def numbered(turns: DataFrame) -> DataFrame:
    """Adds the prefix sum of tokens before each turn of its conversation, and its place."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", n_words(F.col("text")) + TURN_TOKENS).withColumn("bucket", F.coalesce(F.floor(F.col("turn") / BUCKET), F.lit(-(1 << 60))))
    sums = t.groupBy("conv_id", "bucket").agg(F.sum("tokens").alias("sum"), F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("conv_id").alias("b_conv"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base_rows"))
    inner = Window.partitionBy("conv_id", "bucket").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    inside = t.withColumn("prefix", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).withColumn("place", F.coalesce(F.count("*").over(inner), F.lit(0)))
    out = inside.join(bases, inside["conv_id"].eqNullSafe(bases["b_conv"]) & (inside["bucket"] == bases["b_bucket"]))
    return out.select("conv_id", "role", "text", "tokens", (F.col("prefix") + F.col("base")).alias("prefix"), (F.col("place") + F.col("base_rows")).alias("place"))


def format_windows(turns: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_repeated, n_turns, formatted, loss): loss has the (start, length) in code points of learnt texts."""
    if history >= stride:
        raise ValueError("history must be shorter than the stride")
    own = materialize(numbered(turns).withColumn("window", F.floor(F.col("prefix") / stride)), "chat-turns")
    spans = own.groupBy("conv_id", "window").agg(F.min("prefix").alias("from"))
    after = Window.partitionBy("conv_id").orderBy("window")
    nexts = spans.select("conv_id", F.col("window").alias("w"), F.lead("window").over(after).alias("next"), F.lead("from").over(after).alias("next_from"))
    nexts = nexts.withColumnRenamed("conv_id", "n_conv")
    tail = own.join(nexts, own["conv_id"].eqNullSafe(nexts["n_conv"]) & (own["window"] == nexts["w"])).filter("next is not null")
    # history < stride: a turn can be repeated in the next window alone.
    system = (F.col("place") == 0) & (F.col("role") == "system")
    tail = tail.filter((F.col("next_from") - F.col("prefix") <= history) & ~system)
    heads = own.filter(system).select(F.col("conv_id").alias("s_conv"), "role", "text", "place")
    later = spans.filter("window > 0").select("conv_id", "window")
    again = later.join(heads, later["conv_id"].eqNullSafe(heads["s_conv"]))
    rows = own.select("conv_id", "window", "place", "role", "text", F.lit(False).alias("repeated"))
    for more in (tail.select("conv_id", F.col("next").alias("window"), "place", "role", "text"), again.select("conv_id", "window", "place", "role", "text")):
        rows = rows.unionByName(more.withColumn("repeated", F.lit(True)))
    lead = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(">"))
    body = escape(F.col("text"))
    rows = rows.select("conv_id", "window", F.struct("place", lead.alias("lead"), body.alias("body"), "repeated", ((F.col("role") == "assistant") & ~F.col("repeated")).alias("learn")).alias("t"))
    groups = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    size = lambda t: F.length(t["lead"]) + F.length(t["body"]) + len(CLOSE)
    step = lambda acc, t: F.struct(
        (acc["at"] + size(t)).alias("at"),
        F.when(t["learn"], F.array_append(acc["loss"], F.struct((acc["at"] + F.length(t["lead"])).alias("start"), F.length(t["body"]).alias("length")))).otherwise(acc["loss"]).alias("loss"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    return groups.select(
        "conv_id", "window", F.size(F.filter("ts", lambda t: t["repeated"])).alias("n_repeated"), F.size("ts").alias("n_turns"),
        F.concat_ws("", F.transform("ts", lambda t: F.concat(t["lead"], t["body"], F.lit(CLOSE)))).alias("formatted"),
        F.aggregate("ts", zero, step)["loss"].alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: a stream over sorted rows, one window in memory at a time."""

    @lean
    def run(batches):
        out, open_, key = [], None, object()

        def close():
            if open_:
                out.append((key, open_[0], open_[1].hexdigest(), open_[2], open_[3].hexdigest(), open_[4]))

        for batch in batches:
            for r in batch.to_pylist():
                if open_ is None or r["conv_id"] != key:
                    close()
                    key, open_ = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = r["formatted"]
                for role, said in parse(text)[r["n_repeated"] :]:
                    open_[0] += 1
                    open_[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in r["loss"]:
                    said = unescape(text[span["start"] : span["start"] + span["length"]])
                    open_[2] += len(said)
                    open_[3].update(said.encode("utf-8", "surrogatepass"))
                open_[4] += len(text)
            if len(out) >= 1000:
                yield _rows(out)
                out = []
        close()
        yield _rows(out)

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.select("conv_id", "n_repeated", "formatted", "loss").mapInArrow(run, _DIGEST)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    cols = list(zip(*out, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _DIGEST.split(", ")])


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings of a common chat template."""
    said = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return turns.unionByName(extra)


def op5_chat_windows(spark, sf_dir: str) -> DataFrame:
    return read_back(materialize(format_windows(conversations(spark, sf_dir)), "chat-windows"))
