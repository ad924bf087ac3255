"""Operator 9: quality rules with robust multivariate outliers.

Base rules come first. Every other document has a vector of transformed statistics; each (language, source) group gets
a minimum-covariance-determinant estimate of its centre and scatter, and documents whose squared Mahalanobis distance
exceeds a chi-square quantile are rejected.

The estimate is that of several starts around the group's medians: distances scaled by FLOOR, by quartiles, by the scatter of squashed
values, and by that of directions alone. From each, concentration steps go on until the determinant of the half-set's scatter falls
no more, and the start with the least determinant wins. No step brings a group together: counts, sums and products are added up by
(group, start, distance bin), and the half-set of h = (n + p + 1) / 2 rows is the nearest bins, of the last one the share that makes up h.
Statistics are whole multiples of 1 / UNIT, so all sums are sums of whole numbers: neither the estimate nor a distance depends on the
order of rows, and reruns give the same bits. FLOOR is added to the scatter, which keeps it away from zero where most
documents have the same value. Groups under MIN_ROWS are pooled by language, and those under it again in one pool.

Null text has no words and fails the base rules; null language or source are groups of their own; repeated rows count as
often as they occur; columns of docs with the names of those added are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.bpe import as_bytes
from corvane.llm.common import documents, extended, lean, materialize
from corvane.llm.ngram_join import in_order
from corvane.llm.wordhash import Chunk, chunks

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_ROWS = 50
UNIT = 4096
#: Bytes of texts whose words are taken together.
CHUNK = 1 << 18
#: So many rows of a table with a row for each group, or each group and start, are broadcast; more are joined as Spark sees fit.
FEW = 4096
#: A step that shrinks the determinant by less than this share is the last one of its start.
SETTLED = 1e-6
TAIL = 1e-6
FEATURES = ("f_word", "f_symbol", "f_repeat", "f_lines")
FLOOR = (0.05, 0.04, 0.15, 0.1)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*STATS, "base_failed", "distance2", "kept")
P = len(FEATURES)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice among words."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * len(ids) + a[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def repeats(c: Chunk) -> np.ndarray:
    """``repeated_words`` of every text of a chunk with places: hashes of windows find those that may be equal, and their words are compared."""
    place = np.flatnonzero(c.valid(3))
    doc, key = np.repeat(np.arange(len(c.sizes)), c.sizes), c.windows(3)[place]
    order = in_order(doc[place], key, key, len(c.sizes))
    at, key = place[order], key[order]
    some = np.flatnonzero((key[1:] == key[:-1]) & (doc[at[1:]] == doc[at[:-1]]))
    i, j = at[some], at[some + 1]
    raw, wrong = np.frombuffer(c.raw, np.uint8), np.zeros(len(i), bool)
    for k in range(3):
        size = c.end[i + k] - c.start[i + k]
        wrong |= size != c.end[j + k] - c.start[j + k]
        alike = np.flatnonzero(~wrong)
        row = np.repeat(alike, size[alike])
        step = np.arange(len(row)) - np.repeat(np.cumsum(size[alike]) - size[alike], size[alike])
        wrong[row[raw[c.start[i[row] + k] + step] != raw[c.start[j[row] + k] + step]]] = True
    covered = np.zeros(len(doc), bool)
    for k in range(3):
        covered[i + k] = covered[j + k] = True
    out = np.bincount(doc[covered], minlength=len(c.sizes))
    for d in np.unique(doc[i[wrong]]).tolist():  # different words of one hash
        some = range(c.first[d], c.first[d + 1])
        out[d] = repeated_words([c.raw[c.start[w] : c.end[w]] for w in some])
    return out


def text_stats(text: pa.Array) -> list[pa.Array]:
    """The STATS of each text of an Arrow string array."""
    out = np.zeros((len(STATS), len(text)), np.int64)
    points = pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False)
    texts = as_bytes(text)
    for a, b in chunks(texts, CHUNK):
        c = Chunk(texts[a:b], places=True)
        solid = np.concatenate([[0], np.cumsum(c.end - c.start)])
        size = np.array([len(x or b"") for x in texts[a:b]], np.int64)
        out[0, a:b], out[4, a:b] = c.sizes, repeats(c)
        out[1, a:b] = points[a:b] - (size - (solid[c.first[1:]] - solid[c.first[:-1]]))
    for i, raw in enumerate(texts):
        if not raw:
            continue
        lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
        out[2:4, i] = len(raw) - len(raw.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines))
    return [pa.array(x) for x in out]


def with_stats(docs: DataFrame) -> DataFrame:
    """docs with the STATS of their text; columns of docs with those names are replaced."""
    docs = docs.drop(*ADDED)
    schema = extended(docs, **dict.fromkeys(STATS, "long"))

    @lean
    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, *text_stats(text)], names=[*batch.schema.names, *STATS])

    out = docs.mapInArrow(run, schema)
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return out.withColumn("base_failed", failed)


def feature_columns() -> dict[str, Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda a, b: F.sqrt(F.least(F.lit(1.0), a / b))
    return {
        "f_word": F.log(chars / n), "f_symbol": share(F.col("n_symbols"), chars), "f_repeat": F.asin(share(F.col("n_repeat_words"), n)), "f_lines": share(F.col("n_dup_lines"), n),
    }


def chi2_cdf(x: float, df: int) -> float:
    """Of an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < q else (low, mid)
    return high


def consistency(share: float) -> float:
    """Makes the scatter of this share of innermost rows that of all rows of a normal sample."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


CUTOFF = chi2_quantile(1 - TAIL, P)

_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_STATE = "fit_key string, start int, mean array<double>, precision array<double>, det double, done boolean"


def distance2(x: list[Column], mean: Column, precision: Column) -> Column:
    """Of whole multiples of 1 / UNIT."""
    d = [x[i] / float(UNIT) - mean[i] for i in range(P)]
    return sum((precision[k] * d[i] * d[j] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


def _bin(d2: Column) -> Column:
    """32 bins for each doubling; all distances fall in a few hundred bins."""
    return F.floor(F.log2(F.greatest(F.lit(2.0**-10), F.least(d2, F.lit(2.0**30)))) * 32).cast("int")


def square(upper: list[float]) -> np.ndarray:
    out = np.zeros((P, P))
    for k, (i, j) in enumerate(_PAIRS):
        out[i, j] = out[j, i] = upper[k]
    return out


def estimate(n: float, sums: np.ndarray, products: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, precision, determinant) of n rows with these sums and sums of products, ``share`` of their group."""
    mean = sums / n
    cov = consistency(share) * (square(products / n) - np.outer(mean, mean)) if share < 1 else square(products / n) - np.outer(mean, mean)
    cov = cov + np.diag(np.square(FLOOR))
    return mean, np.linalg.inv(cov), float(np.linalg.det(cov))


def few(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows, to be broadcast if they are counted and few: the documents then stay where they are, however hot their group is."""
    return F.broadcast(rows) if (rows.count() if n is None else n) <= FEW else rows


def half(n: int) -> int:
    return min(n, (n + P + 1) // 2)


def _concentrate(pdf):
    """The bins of one group and start -> its next state: a few hundred rows at most, whatever the number of documents."""
    import pandas as pd

    pdf = pdf.sort_values("bin")
    n = pdf["n"].to_numpy()
    upto = np.cumsum(n)
    need = half(int(upto[-1]))
    last = int(np.searchsorted(upto, need))
    weight = np.where(np.arange(len(n)) < last, 1.0, 0.0)
    weight[last] = (need - (upto[last] - n[last])) / n[last]
    add = lambda name, unit: float(sum(w * v for w, v in zip(weight.tolist(), pdf[name].tolist(), strict=True) if w)) / unit
    sums, products = np.array([add(f"s{i}", UNIT) for i in range(P)]), np.array([add(f"q{i}{j}", UNIT**2) for i, j in _PAIRS])
    mean, precision, det = estimate(need, sums, products, need / upto[-1])
    old = pdf.iloc[0]
    better = det < old["det"] * (1 - SETTLED)
    if not better:  # what was there is as good
        return pd.DataFrame({"fit_key": [old["fit_key"]], "start": [old["start"]], "mean": [list(old["mean"])], "precision": [list(old["precision"])], "det": [old["det"]], "done": [True]})
    return pd.DataFrame({"fit_key": [old["fit_key"]], "start": [old["start"]], "mean": [mean.tolist()], "precision": [[float(precision[i, j]) for i, j in _PAIRS]], "det": [det], "done": [False]})


def quartiles(keyed: DataFrame) -> DataFrame:
    """(fit_key, mid, scale): median and half the distance of the quartiles of each statistic, exact, from counts of its values: UNIT
    values for each step of one, whatever the number of rows."""
    values = keyed.unpivot(["fit_key"], list(FEATURES), "feature", "v").groupBy("fit_key", "feature", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("fit_key", "feature").orderBy("v")
    upto = values.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("fit_key", "feature")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("v")))
    found = upto.groupBy("fit_key", "feature").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, c))
    spread = (F.col("high") - F.col("low")) / (2.0 * UNIT)
    return found.groupBy("fit_key").agg(F.array(*[pick(f, F.col("mid") / float(UNIT)) for f in FEATURES]).alias("mid"), F.array(*[pick(f, spread) for f in FEATURES]).alias("spread"))


def _starts(pdf):
    """Median, quartiles and sums of products of squashed values and of directions -> a group's first states."""
    import pandas as pd

    row = pdf.iloc[0]
    scale = np.hypot(np.array(row["spread"], float) * 1.4826, FLOOR)
    found = [np.diag(np.square(FLOOR)), np.diag(np.square(scale))]
    for name in ("t", "u"):
        form = square([row[f"{name}{i}{j}"] / UNIT**2 / row["n"] for i, j in _PAIRS])
        size = np.sqrt(np.maximum(np.diag(form), 1e-6))
        correlation = form / np.outer(size, size)
        np.fill_diagonal(correlation, 1.01)  # never singular
        found.append(correlation * np.outer(scale, scale))
    rows = [(row["fit_key"], k, list(row["mid"]), [float(np.linalg.inv(c)[i, j]) for i, j in _PAIRS], math.inf, False) for k, c in enumerate(found)]
    return pd.DataFrame(rows, columns=["fit_key", "start", "mean", "precision", "det", "done"])


def starts(keyed: DataFrame) -> DataFrame:
    mid = materialize(quartiles(keyed), "quality-medians").withColumnRenamed("fit_key", "m_key")
    near = keyed.join(few(mid), F.col("m_key") == F.col("fit_key"))
    z = [(F.col(f) / float(UNIT) - F.col("mid")[i]) / F.sqrt(F.pow(F.col("spread")[i] * 1.4826, 2) + FLOOR[i] ** 2) for i, f in enumerate(FEATURES)]
    long = F.sqrt(sum((F.pow(c, 2) for c in z), F.lit(1e-12)))
    whole = lambda c: F.round(c * UNIT).cast("long")
    near = near.select("fit_key", "mid", "spread", *[whole(F.tanh(c)).alias(f"t{i}") for i, c in enumerate(z)], *[whole(c / long).alias(f"u{i}") for i, c in enumerate(z)])
    sums = [F.sum(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}{j}") for k in "tu" for i, j in _PAIRS]
    return near.groupBy("fit_key", "mid", "spread").agg(F.count("*").alias("n"), *sums).groupBy("fit_key").applyInPandas(_starts, _STATE)


def fit(stats: DataFrame, min_rows: int = MIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """Statistics -> (fit_key by language and source, estimate by fit_key: mean, precision and det of the best start)."""
    whole = [F.round(c * UNIT).cast("long").alias(k) for k, c in feature_columns().items()]
    good = materialize(stats.filter(~F.col("base_failed")).select("lang", "source", *whole), "quality-features")
    null = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    own = F.concat_ws("\t", F.lit("own"), F.length(null(F.col("lang"))), null(F.col("lang")), null(F.col("source")))
    pool = F.concat_ws("\t", F.lit("lang"), null(F.col("lang")))
    groups = materialize(good.groupBy("lang", "source").count(), "quality-groups")
    small = groups.filter(F.col("count") < min_rows).groupBy(F.col("lang").alias("l")).agg(F.sum("count").alias("pooled"))
    keys = groups.join(small, F.col("l").eqNullSafe(F.col("lang")), "left").select(
        F.col("lang").alias("k_lang"), F.col("source").alias("k_source"),
        F.when(F.col("count") >= min_rows, own).when(F.col("pooled") >= min_rows, pool).otherwise("all").alias("fit_key"),
    )
    keys = materialize(keys, "quality-keys")
    keyed = good.join(few(keys), F.col("k_lang").eqNullSafe(F.col("lang")) & F.col("k_source").eqNullSafe(F.col("source"))).select("fit_key", *FEATURES)
    x = [F.col(f) for f in FEATURES]
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in _PAIRS]]
    state = materialize(starts(keyed), "quality-starts")
    ended, left = [], state.count()
    while True:  # determinants fall and are bounded below, so every start ends
        open_ = state.filter("NOT done").select(F.col("fit_key").alias("e_key"), "start", "mean", "precision", "det")
        near = keyed.join(few(open_, left), F.col("e_key") == F.col("fit_key"))
        bins = near.groupBy("fit_key", "start", "mean", "precision", "det", _bin(distance2(x, F.col("mean"), F.col("precision"))).alias("bin")).agg(*sums)
        state = materialize(bins.groupBy("fit_key", "start").applyInPandas(_concentrate, _STATE), "quality-step")
        ended.append(state.filter("done"))
        left = state.filter("NOT done").count()
        if not left:
            break
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    best = found.groupBy("fit_key").agg(F.min_by(F.struct("mean", "precision", "det"), F.struct("det", "start")).alias("best")).select("fit_key", "best.*")
    return keys, materialize(best, "quality-estimate")


def judge(stats: DataFrame, keys: DataFrame, estimate: DataFrame) -> DataFrame:
    """stats with distance2 and kept; the estimates have a row per group and are joined by their size."""
    fitted = few(materialize(keys.join(estimate, "fit_key"), "quality-fitted")).select(F.struct("*").alias("__fit"))
    out = stats.join(fitted, F.col("__fit.k_lang").eqNullSafe(stats["lang"]) & F.col("__fit.k_source").eqNullSafe(stats["source"]), "left")
    whole = [F.round(c * UNIT).cast("long") for c in feature_columns().values()]
    d2 = F.round(distance2(whole, F.col("__fit.mean"), F.col("__fit.precision")), 6)
    out = out.withColumn("distance2", d2).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True)))
    return out.select(*stats.columns, "distance2", "kept")


def quality(docs: DataFrame) -> DataFrame:
    """docs with STATS, base_failed, distance2 and kept. The text is read twice instead of being shuffled or stored."""
    keys, estimate = fit(with_stats(docs.select("lang", "source", "text")))
    return judge(with_stats(docs), keys, estimate)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    stats = materialize(with_stats(docs).drop("text"), "quality-stats")
    keys, estimate = fit(stats)
    return judge(stats, keys, estimate).select("doc_id", *STATS, "base_failed", "distance2", "kept")
