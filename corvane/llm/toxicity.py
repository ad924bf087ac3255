r"""Operator 11: toxicity by a weighted lexicon, learned from labels and matched by an Aho-Corasick automaton.

Folding: compatibility forms, lower case, look-alike letters of other scripts (HOMOGLYPHS) and digits or signs that stand for a letter in front of
another one (DIGITS); whatever is no letter or digit becomes one space, so that a pattern that begins with a space begins a word, and one
that ends with one is a whole word.

Lexicon: of the prefixes (MIN_PREFIX to MAX_PREFIX letters) and whole words of labelled texts, those that toxic texts have more often, by the
likelihood ratio of two rates; of patterns that begin alike the one of the largest ratio stays, the longer one if they are as good. Its
weight is the logarithm of the ratio of odds. At most LEXICON patterns with a ratio of LEAST, and SHARE of the best one, at least.
Exceptions: words and pairs of words around a match that labelled clean texts have at least as often as toxic ones, in
EXCEPTION texts or more; what they cover does not count. Score: the weights of all matches by the number of words (and SHORT more, so that one chance match is not all of
a short text), through a logistic curve that is fitted to the labelled texts in bins of that density.

Fitting takes at most SAMPLE labelled rows, those of the smallest hashes of doc_id; every text is scored, as a whole. Near copies of a text count
as one: rows that share the smallest hash of their runs of four words divide one row's weight.

Null and empty texts have no word and get the score of no match; null labels are not used, of repeated ones the larger holds; rows may repeat, and each gets its
score; a null doc_id has no label and is held out. Other columns are not read, whatever their names. Without labels the lexicon is
empty and all scores are alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import documents, lean, materialize

SAMPLE, LEXICON, EXCEPTIONS = 8192, 512, 1024
MIN_PREFIX, MAX_PREFIX = 3, 12
#: Toxic texts that a pattern has at least; its least likelihood ratio, and the least share of the best one.
SUPPORT, LEAST, SHARE = 1, 8.0, 0.05
#: Clean texts that an exception has at least.
EXCEPTION = 5
SHORT = 20
#: Words of a text in which one occurrence counts in full.
FULL = 100
BINS, FINE = 512, 32
#: A row's weight in whole numbers, so that sums do not depend on their order.
UNIT = 5040
FOLDS, HELD_OUT = 5, 0

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ԍ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
              "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
_LOOK = str.maketrans(HOMOGLYPHS)
_SIGN = re.compile(r"[0-9@$!|]+(?=[^\W\d_])")
_SIGNS = str.maketrans(DIGITS)
_REST = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The words of a text as they are matched, a space around each; a space alone if there is none."""
    t = (text or "").lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t).lower().translate(_LOOK)
    t = _REST.sub(" ", _SIGN.sub(lambda m: m[0].translate(_SIGNS), t)).strip()
    return f" {t} " if t else " "


def sketch(words: list[str]) -> int:
    """The smallest hash of four words in a row, in 62 bits; of all of them if they are fewer."""
    if not words:
        return 0
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    n = max(1, len(h) - 3)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(4, len(h))):
            total = (total ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
    return int(total.min() >> np.uint64(2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def _fold_rows(batches):
    for batch in batches:
        texts = [fold(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1), pa.array([sketch(t.split()) for t in texts], pa.int64())], names=["folded", "toxic", "sketch"])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(folded, toxic, weight) of the rows to learn from."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # SAMPLE rows of an id and a bit
    rows = materialize(rows.select("text", "toxic").mapInArrow(lean(_fold_rows), "folded string, toxic boolean, sketch long"), "toxicity-sample")
    alike = rows.groupBy("sketch").agg(F.count("*").alias("alike"))
    return rows.join(alike, "sketch").select("folded", "toxic", F.greatest(F.lit(1), F.floor(UNIT / F.col("alike"))).cast("long").alias("weight"))


def _count(items):
    """(folded, toxic, weight) -> (item, toxic, clean): the weights of the texts that have an item, added up in each task."""

    @lean
    def run(batches):
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = max(FULL, text.count(" ") - 1)
                for item, n in items(text).items():
                    # Once in FULL words is a whole text's worth: chance occurrences in long texts are less.
                    found.setdefault(item, [0, 0])[not toxic] += weight * min(size, n * FULL) // size
        keys = list(found)
        for s in range(0, len(keys), 65536):
            part = keys[s : s + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([found[x][c] for x in part], pa.int64()) for c in (0, 1))], names=["item", "toxic", "clean"])

    return run


def starts(text: str) -> Counter:
    """The prefixes and whole words of a folded text, with the space in front, and how often they occur."""
    out: Counter = Counter()
    for w, n in Counter(text.split()).items():
        for size in range(MIN_PREFIX, min(len(w), MAX_PREFIX) + 1):
            out[f" {w[:size]}"] += n
        if len(w) >= MIN_PREFIX:
            out[f" {w} "] = n
    return out


def _totals(rows: DataFrame) -> tuple[int, int]:
    """Weights of toxic and of clean rows, never 0."""
    got = rows.agg(F.sum(F.when(F.col("toxic"), F.col("weight")).otherwise(0)), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("weight")))).first()
    return max(UNIT, got[0] or 0), max(UNIT, got[1] or 0)


def ratio(toxic, clean, all_toxic: float, all_clean: float):
    """The likelihood ratio of two rates against a common one; columns or numbers."""
    both = (toxic + clean) / (all_toxic + all_clean)
    part = lambda n, rate: F.when(n > 0, n * F.log(rate)).otherwise(0.0)
    own = part(toxic, toxic / all_toxic) + part(all_toxic - toxic, 1 - toxic / all_toxic) + part(clean, clean / all_clean) + part(all_clean - clean, 1 - clean / all_clean)
    common = part(toxic + clean, both) + part(all_toxic + all_clean - toxic - clean, 1 - both)
    return 2 * (own - common)


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Pattern: weight."""
    n_toxic, n_clean = (n / UNIT for n in _totals(rows))
    counts = rows.mapInArrow(_count(starts), "item string, toxic long, clean long").groupBy("item").agg((F.sum("toxic") / UNIT).alias("toxic"), (F.sum("clean") / UNIT).alias("clean"))
    likely = counts.filter((F.col("toxic") >= SUPPORT) & (F.col("toxic") / n_toxic > F.col("clean") / n_clean))
    likely = likely.withColumn("ratio", F.round(ratio(F.col("toxic"), F.col("clean"), n_toxic, n_clean), 6)).filter(F.col("ratio") >= LEAST)
    # Patterns that begin alike are near each other in the order, so some more than LEXICON are looked at.
    best = likely.orderBy(F.col("ratio").desc(), F.length("item").desc(), "item").limit(16 * LEXICON).collect()
    taken: dict[str, float] = {}
    for r in best:
        item = r["item"]
        if len(taken) == LEXICON or r["ratio"] < SHARE * best[0]["ratio"]:
            break
        if any(item.startswith(x) or x.startswith(item) for x in taken):
            continue
        odds = (r["toxic"] + 0.5) * (n_clean - r["clean"] + 0.5) / ((n_toxic - r["toxic"] + 0.5) * (r["clean"] + 0.5))
        taken[item] = round(max(0.0, math.log(odds)), 6)
    return taken


class Matcher:
    """Weights of a folded text's matches, but for those inside an exception."""

    def __init__(self, weights: dict[str, float], exceptions: list[str] = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for x in {**dict.fromkeys(exceptions), **weights}:
            self.automaton.add_word(x, (len(x), weights.get(x), x in set(exceptions)))
        self.some = bool(weights)
        if self.some:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """(first, last, weight) of each match; the place of a span counts from the space in front."""
        if not self.some:
            return []
        found, free = [], []
        for last, (size, weight, is_free) in self.automaton.iter(text):
            if weight is not None:
                found.append((last - size + 1, last, weight))
            if is_free:
                free.append((last - size + 1, last))
        if free and found:
            found = [m for m in found if not any(a <= m[0] and m[1] <= b for a, b in free)]
        return found

    def density(self, text: str) -> float:
        """The weights of all matches over the number of words and SHORT."""
        return sum(w for _, _, w in self.spans(text)) / (max(0, text.count(" ") - 1) + SHORT)


def phrases(text: str, matcher: Matcher) -> Counter:
    """The words of matches, alone and with the word before or after, and how often they occur."""
    out: Counter = Counter()
    for first, last, _ in matcher.spans(text):
        end = text.find(" ", max(last, first + 1))
        word = text[first : end + 1]
        out[word] += 1
        before, after = text.rfind(" ", 0, first), text.find(" ", end + 1)
        if first > 0 and before >= 0:
            out[text[before : end + 1]] += 1
        if after > 0:
            out[text[first : after + 1]] += 1
    return out


def exceptions(rows: DataFrame, weights: dict[str, float]) -> list[str]:
    """Phrases around matches that speak for a clean text."""
    if not weights:
        return []
    n_toxic, n_clean = _totals(rows)

    def around():
        matcher = Matcher(weights)
        return lambda text: phrases(text, matcher)

    def run(batches):
        yield from _count(around())(batches)

    counts = rows.mapInArrow(run, "item string, toxic long, clean long").groupBy("item").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    clean = counts.filter((F.col("clean") >= EXCEPTION * UNIT) & (F.col("toxic") / n_toxic <= F.col("clean") / n_clean))
    return [r["item"] for r in clean.orderBy(F.col("clean").desc(), "item").limit(EXCEPTIONS).collect()]


def bin_of(density: float) -> int:
    return min(BINS - 1, int(FINE * math.log1p(100 * density)))


def curve(counts: dict[tuple[int, bool], float]) -> tuple[float, float]:
    """(slope, offset) of the logistic curve over bin / FINE, with counts by bin and label; labels are drawn in a little."""
    toxic, clean = sum(n for (_, t), n in counts.items() if t), sum(n for (_, t), n in counts.items() if not t)
    x = np.array([b / FINE for b, _ in counts] + [0.0])
    y = np.array([(toxic + 1) / (toxic + 2) if t else 1 / (clean + 2) for _, t in counts] + [0.25])
    n = np.array([*counts.values(), 1.0])  # one row more, with a chance of a quarter, for tables without labels
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(w[0] * x + w[1])))
        g = np.array([(n * (p - y) * x).sum() + 1e-3 * w[0], (n * (p - y)).sum()])
        v = n * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model, of a size that LEXICON, EXCEPTIONS and BINS bound."""
    rows = materialize(labelled(docs, labels), "toxicity-rows")
    weights = lexicon(rows)
    without = exceptions(rows, weights)

    def run(batches):
        matcher = Matcher(weights, without)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bin_of(matcher.density(t)) for t in batch.column(0).to_pylist()], pa.int32()), batch.column(1), batch.column(2)], names=["bin", "toxic", "weight"])

    binned = rows.mapInArrow(lean(run), "bin int, toxic boolean, weight long").groupBy("bin", "toxic").agg(F.sum("weight").alias("n")).collect()  # 2 * BINS rows at most
    slope, offset = curve({(r["bin"], r["toxic"]): r["n"] / UNIT for r in binned})
    return {"weights": weights, "exceptions": without, "slope": slope, "offset": offset}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text) -> doc_id, density, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        matcher = Matcher(m["weights"], m["exceptions"])
        for batch in batches:
            density = [matcher.density(fold(t)) for t in batch.column(1).to_pylist()]
            # The curve itself, not its bins: a denser text never scores lower.
            scores = [1 / (1 + math.exp(-max(-700.0, min(700.0, m["slope"] * math.log1p(100 * d) + m["offset"])))) for d in density]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(density, pa.float64()), pa.array(scores, pa.float64())], names=["doc_id", "density", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, density double, score double")


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
