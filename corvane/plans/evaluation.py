"""M7: evaluation over events (values by user and type), vectors and two versions of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import evaluate
from corvane.plans import features
from corvane.plans.base import query
from corvane.sources.tables import table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("""WITH m AS (SELECT event_type, 'value' AS metric, value AS v FROM events UNION ALL SELECT event_type, 'k', CAST(json_extract(props, '$.k') AS DOUBLE) FROM events UNION ALL SELECT event_type, 'bytes', strlen(props)::DOUBLE FROM events)
SELECT event_type, metric, count(*) AS n, round(median(v), 6) AS median, round(quantile_disc(v, 0.95), 6) AS p95 FROM m WHERE v IS NOT NULL GROUP BY ALL""")
def metric_summary(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.octet_length("props").cast("double").alias("bytes"))
    return evaluate.summary(e, ["event_type"], ["value", "k", "bytes"])


#: Samples: a user's n-th click is the baseline of the user's n-th view; cohorts are users modulo 4.
PAIRS = """s AS (SELECT user_id, user_id % 4 AS cohort, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS pair FROM events WHERE event_type IN ('click', 'view')),
p AS (SELECT b.cohort, b.user_id, b.pair, b.value AS base, c.value AS cand FROM s b JOIN s c ON b.user_id = c.user_id AND b.pair = c.pair AND b.event_type = 'click' AND c.event_type = 'view' WHERE b.value > 0)"""


def samples(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = events(spark, sf_dir).filter(F.col("event_type").isin("click", "view"))
    return e.select("user_id", (F.col("user_id") % 4).alias("cohort"), "event_type", "value", F.row_number().over(w).cast("long").alias("pair"))


def pairs(spark, sf_dir):
    """Both sides of a pair by one aggregation instead of a self join."""
    side = lambda t: F.max(F.when(F.col("event_type") == t, F.col("value")))
    g = samples(spark, sf_dir).groupBy("cohort", "user_id", "pair").agg(side("click").alias("base"), side("view").alias("cand"))
    return g.filter("base > 0 AND cand IS NOT NULL")


@query(f"WITH {PAIRS} SELECT cohort, count(*) AS n_pairs, round(median(1 - cand / base), 6) AS median_reduction, count(*) FILTER (pair % 2 = 0) AS base_first FROM p GROUP BY cohort")
def paired_reduction(spark, sf_dir):
    """The median of reductions, which is not the reduction of medians."""
    p = pairs(spark, sf_dir).select("cohort", "pair", (1 - F.col("cand") / F.col("base")).alias("reduction"))
    counts = p.groupBy("cohort").agg(F.count_if(F.col("pair") % 2 == 0).alias("base_first"))
    found = evaluate.medians(p, ["cohort"], "reduction").join(counts, "cohort")
    return found.select("cohort", F.col("n").alias("n_pairs"), F.round("median", 6).alias("median_reduction"), "base_first")


@query(f"WITH {PAIRS}, m AS (SELECT cohort, median(base) AS b, median(cand) AS c FROM p GROUP BY cohort) SELECT cohort, round((b - c) / b * 100, 6) AS percent FROM m")
def median_reduction(spark, sf_dir):
    p = pairs(spark, sf_dir)
    m = evaluate.medians(p, ["cohort"], "base", "b").drop("n").join(evaluate.medians(p, ["cohort"], "cand", "c").drop("n"), "cohort")
    return m.select("cohort", F.round((F.col("b") - F.col("c")) / F.col("b") * 100, 6).alias("percent"))


@query(f"""WITH {PAIRS}, g AS (SELECT count(*) AS n, max(base) AS most, min(cand) AS least, count(*) FILTER (cand <= base) AS better, quantile_disc(cand, 0.95) AS p95 FROM p)
SELECT n > 0 AS has_pairs, most < 1e9 AS bounded, least >= 0 AS not_negative, better * 2 >= n AS mostly_better, p95 < most * 2 AS tail_ok, n > 0 AND most < 1e9 AND least >= 0 AND better * 2 >= n AND p95 < most * 2 AS go FROM g""")
def gates(spark, sf_dir):
    p = pairs(spark, sf_dir)
    g = p.agg(F.count("*").alias("n"), F.max("base").alias("most"), F.min("cand").alias("least"), F.count_if(F.col("cand") <= F.col("base")).alias("better"))
    g = g.crossJoin(evaluate.order_statistics(p, [], "cand", evaluate.P95).select("p95"))  # one row each
    row = {"has_pairs": F.col("n") > 0, "bounded": F.col("most") < 1e9, "not_negative": F.col("least") >= 0, "mostly_better": F.col("better") * 2 >= F.col("n"), "tail_ok": F.col("p95") < F.col("most") * 2}
    everything = None
    for c in row.values():
        everything = c if everything is None else everything & c
    return g.select(*[c.alias(k) for k, c in row.items()], everything.alias("go"))


@query("""WITH v AS (SELECT label, embedding::DOUBLE[] AS a, list_transform(embedding, lambda x: round(x::DOUBLE, 4)) AS b FROM embeddings),
r AS (SELECT label, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS c, list_max(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) AS d, len(a) = len(b) AS dims, len(list_filter(b, lambda x: NOT isfinite(x))) = 0 AS fine FROM v)
SELECT label, count(*) AS n, round(min(c), 6) AS min_cosine, round(max(d), 6) AS max_difference, bool_and(dims) AND bool_and(fine) AND min(c) >= 0.999999 AND max(d) <= 1e-4 AS equivalent FROM r GROUP BY label""")
def vector_equivalence(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("a"), F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("b"))
    a, b = F.col("a"), F.col("b")
    r = v.select("label", V.cosine(a, b).alias("c"), V.max_difference(a, b).alias("d"), ((F.size("a") == F.size("b")) & V.finite(b)).alias("fine"))
    same = F.bool_and("fine") & (F.min("c") >= 0.999999) & (F.max("d") <= 1e-4)
    return r.groupBy("label").agg(F.count("*").alias("n"), F.round(F.min("c"), 6).alias("min_cosine"), F.round(F.max("d"), 6).alias("max_difference"), same.alias("equivalent"))


@query("""WITH r AS (SELECT doc_id, sha256('{"lang":"' || lang || '","n":' || n_chars || ',"sha":"' || sha256(text) || '"}') AS h FROM documents),
a AS (SELECT doc_id // 1000 AS k, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM r GROUP BY 1)
SELECT CASE WHEN (SELECT max(doc_id) FROM documents) < 1000 THEN (SELECT any_value(h) FROM a) ELSE (SELECT sha256(string_agg(h, '' ORDER BY k)) FROM a) END AS table_sha""")
def canonical_hash(spark, sf_dir):
    """The SQL has the two levels that up to a million ids need; here there are as many as the ids ask for."""
    d = table(spark, sf_dir, "documents")
    row = F.to_json(F.struct("lang", F.col("n_chars").alias("n"), T.sha(F.col("text")).alias("sha")), {"ignoreNullFields": "false"})
    return evaluate.merkle(d.select("doc_id", T.sha(row).alias("h")), "doc_id", "h")


NEXT = "(SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || chr(10) || 'MARKER-' || doc_id WHEN doc_id % 17 = 0 THEN substring(text, 1, 100) ELSE text END AS text FROM documents)"


def next_version(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("\nMARKER-"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 17 == 0, F.substring("text", 1, 100)).otherwise(F.col("text"))
    return d.select("doc_id", text.alias("now"))


@query(f"""WITH b AS (SELECT o.doc_id, o.text AS was, n.text AS now, list_distinct({features.LINES.format('o.text')}) AS a, list_distinct({features.LINES.format('n.text')}) AS b FROM documents o JOIN {NEXT} n USING (doc_id))
SELECT doc_id, was = now AS exact_match, contains(now, 'MARKER-') AS has_marker, (length(now) - length(was))::BIGINT AS more_chars, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS lines_lost, len(list_filter(b, lambda x: NOT list_contains(a, x)))::BIGINT AS lines_new FROM b""")
def doc_compare(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("was")).join(next_version(spark, sf_dir), "doc_id")
    a, b = F.array_distinct(T.lines(F.col("was"))), F.array_distinct(T.lines(F.col("now")))
    n = lambda c: F.size(c).cast("long")
    return d.select(
        "doc_id", (F.col("was") == F.col("now")).alias("exact_match"), F.contains("now", F.lit("MARKER-")).alias("has_marker"), (F.length("now") - F.length("was")).cast("long").alias("more_chars"),
        n(F.array_except(a, b)).alias("lines_lost"), n(F.array_except(b, a)).alias("lines_new"),
    )


@query(f"""WITH {features.BM25}, h AS (SELECT l.query_id, bool_or(contains(d.text, b.text)) AS was, bool_or(contains(n.text, b.text)) AS now, count(*) AS rows FROM lexical l JOIN benchmark b ON b.item_id = l.query_id JOIN documents d ON d.doc_id = l.doc_id JOIN {NEXT} n ON n.doc_id = l.doc_id GROUP BY l.query_id)
SELECT count(*) AS questions, count(*) FILTER (was) AS hits_before, count(*) FILTER (now) AS hits_after, count(*) FILTER (was AND NOT now) AS new_misses, max(rows) AS most_rows FROM h""")
def new_misses(spark, sf_dir):
    """Questions whose passage the old version answered and the new one does not."""
    hits = features.bm25(spark, sf_dir).select("query_id", "doc_id")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").join(hits, "doc_id").join(q, "query_id")
    now = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("\nMARKER-"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 17 == 0, F.substring("text", 1, 100)).otherwise(F.col("text"))
    g = texts.groupBy("query_id").agg(F.bool_or(F.contains("text", "passage")).alias("was"), F.bool_or(F.contains(now, F.col("passage"))).alias("now"), F.count("*").alias("rows"))
    return g.agg(F.count("*").alias("questions"), F.count_if("was").alias("hits_before"), F.count_if("now").alias("hits_after"), F.count_if(F.col("was") & ~F.col("now")).alias("new_misses"), F.max("rows").alias("most_rows"))


@query("SELECT event_type AS phase, count(*) AS calls, round(sum(value), 4) AS seconds FROM events GROUP BY event_type")
def phase_totals(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("seconds"))


@query("SELECT event_type, count(*) AS files, round(count(*) / median(value), 6) AS files_per_second FROM events WHERE value > 0 GROUP BY event_type")
def throughput(spark, sf_dir):
    m = evaluate.medians(events(spark, sf_dir).filter("value > 0"), ["event_type"], "value")
    return m.select("event_type", F.col("n").alias("files"), F.round(F.col("n") / F.col("median"), 6).alias("files_per_second"))


@query(rf"""WITH {features.CHUNKS}, t AS (SELECT doc_id, chunk_index, chunk, regexp_extract_all(lower('検索文書: ' || chunk), '[\p{{L}}\p{{N}}]+') AS ts FROM c)
SELECT doc_id, chunk_index, len(ts)::BIGINT AS token_count, sha256(array_to_string(ts, ' ')) AS tokens_sha, sha256(doc_id || '|' || chunk_index || '|' || sha256(chunk)) AS record_sha, ceil(sqrt(len(ts)))::BIGINT AS side FROM t""")
def record_manifest(spark, sf_dir):
    ts = T.tokens(F.concat(F.lit(T.DOCUMENT_PREFIX), "chunk"))
    record = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), T.sha(F.col("chunk")))
    return features.chunk_rows(spark, sf_dir).select("doc_id", "chunk_index", F.size(ts).cast("long").alias("token_count"), T.sha(F.concat_ws(" ", ts)).alias("tokens_sha"), T.sha(record).alias("record_sha"), F.ceil(F.sqrt(F.size(ts))).alias("side"))
