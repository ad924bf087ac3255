"""Operator 2: line dedup by a suffix array over line ids, ranked by distributed prefix doubling.

A document is the sequence of its lines that hold a word, a line's id a 128-bit hash. Lines that occur once end every repeated run, so
one packed exchange drops them first; the suffixes that begin at other lines are rows (shard, text, place). Their ranks by the first
2**k lines are order-preserving numbers: equal keys are counted, the distinct ones are sorted by range over the cluster and numbered in
that order, and the next key of a suffix is its rank and the rank 2**k lines further on, found by a join at that distance. Suffixes whose
first 2**k lines occur once are complete and go on no further, so rounds shrink.

Suffixes that share their first n lines are a longest-common-prefix interval of the array: for a power of two those of one rank, for
other lengths those that share the two ranks which cover n lines. Every interval has a first place in the corpus, in the order of doc_id (null
last), text hash, row and line; its other members are later copies. A run counts from min_words words on. Each line starts one shortest
run of that many words and ends one, and a line is in a later copy of such a run just if one of these is a later copy, so doubling ends when
ranks name the longest of them. Later copies are deleted; touching ones are one maximal run.

Lines without words stay unless all other lines go; a document that loses all its words is empty text. Null text
stays null; rows alike in id and text are copies of each other, and one of them keeps its lines; an empty table gives no
rows. Other columns stay as they are, but those named as the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import documents, extended, lean, materialize, partitions
from corvane.llm.shards import Keys, Shards, text_of, unpack_docs

#: Of a repeated run. On sf0.1, 21 % of all different lines of one or two words repeat, 13 % of those of three or four, 11 % of five to
#: nine and 7 % of longer ones: by that, about half of the different repeated lines below three words repeat by chance and not as copies.
MIN_WORDS = 3
_U = np.uint64
_PLACE = ["shard", "text", "place"]
_SUFFIX = "shard long, text int, place int, hi long, lo long, last boolean, doc_id long, tie long, reach int, runs array<int>"


class Lines:
    """Of one shard: the lines with words, text after text, and the shortest runs of min_words from and to each."""

    def __init__(self, table: pa.Table):
        self.texts = text_of(table)
        self.ids = table["doc_id"].cast(pa.int64()).to_pylist() if "doc_id" in table.column_names else [None] * len(self.texts)
        self.lines, hi, lo, words, doc = [], [], [], [], []
        for d, raw in enumerate(self.texts):
            lines = (raw or b"").split(b"\n")
            self.lines.append(lines)
            for line in lines:
                n = len(line.split())
                if n:
                    h = xxhash.xxh3_128_intdigest(line)
                    hi.append(h >> 64)
                    lo.append(h & 0xFFFFFFFFFFFFFFFF)
                    words.append(n)
                    doc.append(d)
        self.hi, self.lo, self.words, self.doc = np.array(hi, _U), np.array(lo, _U), np.array(words, np.int64), np.array(doc, np.int64)
        self.first = np.searchsorted(self.doc, np.arange(len(self.texts) + 1))

    def keys(self, buckets: int) -> Keys:
        return Keys(self.hi, None, np.ones(len(self.hi), bool), buckets)

    def runs(self, min_words: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the shortest runs from and to each line, of which all lines are among ``some``; each once."""
        n = len(self.words)
        i, upto = np.arange(n), np.concatenate([[0], np.cumsum(self.words)])
        stop = np.searchsorted(upto, upto[:-1] + min_words)  # run i..stop-1
        begin = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1  # run begin..i
        ahead = np.flatnonzero(stop <= self.first[self.doc + 1]) if n else i
        back = np.flatnonzero((begin >= self.first[self.doc]) & (upto[1:] >= min_words)) if n else i
        both = np.unique(np.concatenate([i[ahead] << 31 | stop[ahead], begin[back] << 31 | i[back] + 1]))  # a run may be both
        start, stop = both >> 31, both & (2**31 - 1)
        once = np.concatenate([[0], np.cumsum(~some)])
        whole = once[stop] == once[start]
        return start[whole], (stop - start)[whole]

    def reach(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The length of the longest of these runs that covers each line; 0 for lines in none."""
        out = np.zeros(len(self.words), np.int64)
        for n in np.unique(length):
            change = np.zeros(len(out) + 1, np.int64)
            np.add.at(change, start[length == n], 1)
            np.add.at(change, start[length == n] + n, -1)
            out[np.cumsum(change)[:-1] > 0] = n
        return out

    def kept(self, start: np.ndarray, length: np.ndarray) -> tuple[list[bytes | None], list[int]]:
        """Texts without the lines covered by these runs, and how many went."""
        change = np.zeros(self.first[-1] + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + length, -1)
        cut = np.cumsum(change)[:-1] > 0
        out, removed = [], []
        for d, (raw, lines) in enumerate(zip(self.texts, self.lines, strict=True)):
            flags = cut[self.first[d] : self.first[d + 1]]
            n = int(flags.sum())
            removed.append(n)
            if not n:
                out.append(raw)
            elif n == len(flags):
                out.append(b"")
            else:
                marks = iter(flags.tolist())
                out.append(b"\n".join([x for x in lines if not (x.split() and next(marks))]))
        return out, removed


def _ask_lines(buckets: int):
    @lean
    def run(batches):
        for batch in batches:
            for shard, raw in zip(batch["shard"].to_pylist(), batch["docs"].to_pylist(), strict=True):
                yield Lines(unpack_docs(raw)).keys(buckets).rows(shard, buckets)

    return run


def _suffixes(min_words: int, buckets: int):
    """A row for each line of a shortest run whose lines may all occur twice: the longest such run around it, the lengths of those that start
    there. All places of a repeated run are such lines, so nothing else is ranked."""

    @lean
    def run(batches):
        for batch in batches:
            for shard, raw, answer in zip(*(batch[k].to_pylist() for k in ("shard", "docs", "answer0")), strict=True):
                x = Lines(unpack_docs(raw))
                some = x.keys(buckets).answered(answer)
                start, length = x.runs(min_words, some)
                reach = x.reach(start, length)
                at = np.flatnonzero(reach)
                doc, m = x.doc[at], len(at)
                tie = np.array([xxhash.xxh3_64_intdigest(t or b"") >> 1 for t in x.texts], np.int64)
                offsets = np.searchsorted(start, np.append(at, len(some)))
                ids = pa.array(x.ids, pa.int64()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * m, pa.int64()), pa.array(doc.astype(np.int32)), pa.array((at - x.first[doc]).astype(np.int32)), pa.array(x.hi[at].view(np.int64)), pa.array(x.lo[at].view(np.int64)),
                        ids.is_null(), ids, pa.array(tie[doc]), pa.array(reach[at].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(length.astype(np.int32))),
                    ],
                    names=[c.split()[0] for c in _SUFFIX.split(", ")],
                )

    return run


def _in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with ``number``, ascending in the order of the keys over the whole cluster: ranges of keys are partitions, and a number is
    the partition's and the place in it."""
    ordered = rows.repartitionByRange(max(2, partitions(rows.sparkSession)), *keys).sortWithinPartitions(*keys)
    return ordered.withColumn("number", F.monotonically_increasing_id())


def _ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of suffixes -> those whose keys occur twice, with rank (in the order of the keys) and later (not the first place of its rank)."""
    groups = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("at").alias("first")).filter("n > 1"), "line-intervals")
    ranks = materialize(_in_order(groups.select(*keys, "first"), *keys).withColumnRenamed("number", "rank"), "line-ranks")
    return materialize(rows.join(ranks, list(keys)).select(*_PLACE, "at", "reach", "runs", "rank", (F.col("at") != F.col("first")).alias("later")), "line-suffixes")


def later_copies(suffixes: DataFrame) -> DataFrame:
    """(shard, text, place, length) of the runs that an earlier place in the corpus has too."""
    order = ["last", "doc_id", "tie", *_PLACE]
    rows = materialize(_in_order(suffixes, *order).withColumnRenamed("number", "at").select(*_PLACE, "at", "hi", "lo", "reach", "runs"), "line-places")
    longest = rows.agg(F.max("reach")).first()[0] or 0
    level, span, found = _ranked(rows, "hi", "lo"), 1, []
    while span <= longest:
        # Intervals of this many lines are ranks; those of up to twice as many are pairs of ranks.
        found.append(level.filter(F.col("later") & F.array_contains("runs", span)).select(*_PLACE, F.lit(span).alias("length")))
        if span > 1:
            longer = level.select(*_PLACE, "at", F.col("rank").alias("left"), F.explode(F.filter("runs", lambda n: (n > span) & (n < 2 * span))).alias("length"))
            ends = level.select("shard", "text", F.col("place").alias("end"), F.col("rank").alias("right"))
            named = longer.withColumn("end", F.col("place") + F.col("length") - span).join(ends, ["shard", "text", "end"])
            named = materialize(named.select(*_PLACE, "at", "length", "left", "right"), "line-runs")
            firsts = named.groupBy("length", "left", "right").agg(F.min("at").alias("first"))
            found.append(named.join(firsts, ["length", "left", "right"]).filter("at != first").select(*_PLACE, "length"))
        if 2 * span > longest:
            break
        # The rank that stands this many lines further on, where a run is long enough to need it.
        open_ = level.filter(F.col("reach") >= 2 * span)
        further = open_.select("shard", "text", (F.col("place") - span).alias("place"), F.col("rank").alias("right"))
        pairs = materialize(open_.select(*_PLACE, "at", "reach", "runs", F.col("rank").alias("left")).join(further, _PLACE), "line-pairs")
        if pairs.isEmpty():
            break
        level, span = _ranked(pairs, "left", "right"), 2 * span
    out = found[0] if found else suffixes.select(*_PLACE, F.lit(0).alias("length")).filter("false")
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _apply(names: list[str]):
    @lean
    def run(batches):
        for batch in batches:
            for raw, runs in zip(batch["docs"].to_pylist(), batch["later"].to_pylist(), strict=True):
                docs = unpack_docs(raw)
                x = Lines(docs)
                start = np.array([x.first[r["text"]] + r["place"] for r in runs or ()], np.int64)
                kept, removed = x.kept(start, np.array([r["length"] for r in runs or ()], np.int64))
                text = docs.schema.field("text").type
                at = docs.column_names.index("text")
                docs = docs.set_column(at, docs.schema.field(at), pa.array(kept, pa.binary()).cast(text))
                yield from pa.table([*docs.columns, pa.array(np.diff(x.first)), pa.array(removed, pa.int64())], names=names).to_batches()

    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines that stay as text, n_lines (with words, before) and lines_removed."""
    docs = docs.drop("n_lines", "lines_removed")
    schema = extended(docs, n_lines="long", lines_removed="long")
    with Shards(docs) as shards:
        n = shards.buckets
        twice = shards.exchange(shards.rows().mapInArrow(_ask_lines(n), "bucket int, shard long, keys binary"), "line-names")
        suffixes = materialize(shards.rows(twice).mapInArrow(_suffixes(min_words, n), _SUFFIX), "line-candidates")
        later = materialize(later_copies(suffixes), "line-copies")
        return materialize(shards.beside(later, "later").mapInArrow(_apply(schema.names), schema), "lines-out")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "lines_removed", F.sha2("text", 256).alias("kept_sha256"))
