"""Many strings sought at once: one pass of an Aho-Corasick automaton over each document.

The strings are cut into shards of CHARS characters or so, whose automata a task builds when it meets them and keeps, HELD of them at most. Shards of
FEW characters in all are broadcast, once to each worker, and every document is read once; beyond that, documents meet the shards by a cartesian product, each
pair of partitions in a task of its own, and nothing that is broadcast grows. Strings are sought as they are written.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import blocks

CHARS = 1 << 20
FEW = 4 << 20
HELD = 2


def _automaton(texts: list[str]):
    """Of strings that may repeat, each with the places where it stands in the list."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        places.setdefault(t, []).append(i)
    built = ahocorasick.Automaton()
    for t, own in places.items():
        built.add_word(t, own)
    built.make_automaton()
    return built


def holders(docs: DataFrame, strings: DataFrame, chars: int = CHARS, few: int = FEW) -> DataFrame:
    """(query_id, doc_id): the docs(doc_id, text) that hold a string of strings(query_id, text), once each. Blank and null strings are in none."""
    asked = strings.select("query_id", F.col("text").alias("sought")).filter(F.col("sought").isNotNull() & ~T.blank(F.col("sought")))
    total = asked.agg(F.coalesce(F.sum(F.length("sought").cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-total // chars))
    shard = F.pmod(F.xxhash64("query_id", "sought"), F.lit(shards)).cast("int").alias("shard")
    sides = asked.groupBy(shard).agg(F.collect_list(F.struct("query_id", "sought")).alias("asked"))
    q_type, d_type = strings.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()

    def hits(automaton, queries, ids, texts):
        at, met = [], []
        for i, t in enumerate(texts):
            found = {p for _, places in automaton.iter(t.as_py()) for p in places}
            at += [i] * len(found)
            met += found
        return pa.RecordBatch.from_arrays([queries.take(pa.array(met, pa.int64())), ids.take(pa.array(at, pa.int64()))], names=["query_id", "doc_id"])

    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    schema = f"query_id {q_type}, doc_id {d_type}"
    if total <= few:
        carrier = blocks.carried(sides.select("asked"))

        def run(batches):
            sides = [row["asked"].values for row in blocks.unpacked(carrier)]
            built = [(_automaton(side.field("sought").to_pylist()), side.field("query_id")) for side in sides]
            for batch in batches:
                for automaton, queries in built:
                    yield hits(automaton, queries, batch.column(0), batch.column(1))

        return rows.mapInArrow(run, schema)

    def pairs(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            shard_of = batch.column(2).to_pylist()
            for number in dict.fromkeys(shard_of):
                some = pa.array([i for i, s in enumerate(shard_of) if s == number], pa.int64())
                if number not in held:
                    while len(held) >= HELD:
                        held.pop(next(iter(held)))
                    side = batch.column(3)[some[0].as_py()].values
                    held[number] = (_automaton(side.field("sought").to_pylist()), side.field("query_id"))
                yield hits(*held[number], batch.column(0).take(some), batch.column(1).take(some))

    met = rows.crossJoin(sides.repartitionByRange(shards, "shard"))
    return met.select("doc_id", "text", "shard", "asked").mapInArrow(pairs, schema)
