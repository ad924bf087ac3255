r"""Operator 13: conversations put back into the form ``(s?(ua)+)?`` of role initials by the cheapest edits, found by A* on the edit lattice.

A node of the lattice is (rows read, state); the states are nothing yet, after the system row, after a user's, after an assistant's. Edits: Keep
(0, where the row's initial is what the state takes), Rerole to the user or assistant that the state takes (2), Delete (3; the one edit of
blank and duplicate rows), Insert an empty user or assistant (2); a truncated row that is not deleted costs 1 more. The
heuristic of a node is a suffix sum over the rows ahead: 3 for each that has to be deleted, 1 for each truncated one (kept or deleted, it costs as
much at least). It never falls by more than an edit costs, so the first time that a node leaves the queue, which is keyed
(cost + heuristic, audit), it does so by its cheapest edits and, of those, the ones whose initials come first in ASCII.

Long conversations: rows are dealt by range of (conversation, turn, role, hash of text), so that one of them is many tasks, and cut into segments of
SEGMENT rows, or fewer at the edge of a task. A segment that doesn't begin its conversation is searched from each state, to each state; inserts
stand in front of a row, so no audit of a segment begins another one of the same rows, and the order of two audits is decided in the
first segment where they part. A pass over the costs and ranks of the segments alone, then one backwards, choose their ends. Texts are hashed in
one stream for each conversation, a row in memory at a time, which SHA-256 asks for.

Null conv_id, turn, role and text count as one space where a row is damaged; null turns come first, rows of one turn are ordered by role, then by
SHA-256 of the text. A null conv_id is a conversation of its own. An empty role has no initial: it may be kept anywhere and changes no state.
Repeated rows are duplicates. Conversations that lose all rows have zeros. Other columns are not read, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, lean, materialize, partitions

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
SEGMENT = 1024
MODULUS = 20
#: Rows of a batch between two writes.
ROWS = 4096

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of an initial; what a state takes of user and assistant; where a conversation may end.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
TAKES = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")


def search(initials: list[str], faults: list[str], state: int = START, last: bool = True) -> dict[int, tuple[int, str]]:
    """State at the end: (cost, audit), by A* over rows of the initials with their first faults. ``last``: inserts may follow the last row,
    and the states are those where a conversation may end; the cheapest is enough then."""
    n = len(initials)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if faults[k] in ("blank", "duplicate") else TRUNCATED if faults[k] == "truncated" else 0)
    queue, closed, found = [(ahead[0], "", 0, state)], set(), {}
    while queue:
        key, audit, k, at = heapq.heappop(queue)
        if (k, at) in closed:
            continue
        closed.add((k, at))
        cost = key - ahead[k]
        if k == n:
            if last and at in ENDS:
                return {at: (cost, audit)}
            if not last:
                found[at] = (cost, audit)
                if len(found) == 4:
                    break
                continue
        steps = [("I", k, NEXT[at, TAKES[at]], INSERT)]
        if k < n:
            steps.append(("D", k + 1, at, DELETE))
            if faults[k] not in ("blank", "duplicate"):
                more = TRUNCATED if faults[k] == "truncated" else 0
                steps.append(("R", k + 1, NEXT[at, TAKES[at]], REROLE + more))
                kept = at if not initials[k] else NEXT.get((at, initials[k]))
                if kept is not None:
                    steps.append(("K", k + 1, kept, KEEP + more))
        for letter, to, then, costs in steps:
            if (to, then) not in closed:
                heapq.heappush(queue, (cost + costs + ahead[to], audit + letter, to, then))
    return found


def apply(state: int, initials: list[str], audit: str) -> list[tuple[int, str, str]]:
    """(row, edit, role or "") of each edit; row is the place it stands in front of or changes, len(initials) behind the last."""
    out, k = [], 0
    for letter in audit:
        role = ROLES[TAKES[state]] if letter in "IR" else ""
        out.append((k, letter, role))
        if letter in "IR":
            state = NEXT[state, TAKES[state]]
        elif letter == "K" and initials[k]:
            state = NEXT[state, initials[k]]
        k += letter != "I"
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with damage by crc32 of "conv_id:turn": one of twenty is dropped, emptied, robbed of its ends, repeated or
    given to the user, each."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % MODULUS).alias("case")).filter("case != 0")
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    t = t.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "case")
    return t.withColumn("copy", F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def placed(turns: DataFrame) -> DataFrame:
    """turns in order by range: place grows with (conversation, turn, role, hash). Equal rows are dealt by a number of their own, so a third of all
    rows being alike is many ranges too."""
    spark = turns.sparkSession
    t = turns.withColumn("key", F.unhex(F.sha2("text", 256)))
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    fault = F.when(~F.col("text").rlike(WORD), "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    t = materialize(t.withColumn("fault", fault).withColumn("own", F.monotonically_increasing_id()), "repair-damaged")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "key", "own"]
    ranged = t.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("place", F.monotonically_increasing_id()).drop("own"), "repair-placed")


def _segments(size: int):
    """Rows (place, conv_id, role, fault, first, begins, ends) in order, each behind its marks -> segments with the audits of all ends."""

    @lean
    def run(batches):
        out, held, conv = [], [], None

        def close():
            if not held:
                return
            initials, faults = [r[1] for r in held], [r[2] for r in held]
            begins, ends = held[0][3], held[-1][4]
            answers = {s: search(initials, faults, s, ends) for s in ([START] if begins else range(4))}
            paths = sorted((s, e, *v) for s, found in answers.items() for e, v in found.items())
            kinds = [sum(f == x for f in faults) for x in ("blank", "duplicate", "truncated")]
            wrong = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            out.append((conv, held[0][0], begins, ends, [r[0] for r in held], initials, *kinds, wrong, [{"entry": p[0], "exit": p[1], "cost": p[2], "audit": p[3]} for p in paths]))
            held.clear()

        marks: dict[str, bool] = {}
        at = None
        for batch in batches:
            for place, kind, c, role, fault in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if place != at:
                    at, marks = place, {}
                if kind != "row":
                    marks[kind] = True
                    continue
                if held and (c != conv or held[-1][4] or "begins" in marks):
                    close()
                conv = c
                fault = fault if fault == "blank" else "duplicate" if "first" not in marks else fault
                held.append((place, role[:1], fault, "begins" in marks, "ends" in marks))
                if len(held) == size:
                    close()
                if len(out) * 16 >= ROWS:
                    yield _batch(out)
                    out = []
        close()
        yield _batch(out)

    return run


_SEGMENT = "conv_id {}, place long, begins boolean, ends boolean, places array<long>, initials array<string>, blank long, duplicate long, truncated long, wrong long, paths array<struct<entry:int,exit:int,cost:long,audit:string>>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    paths = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    kinds = [None, pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.int64()] * 4, paths]
    names = [x.split()[0] for x in _SEGMENT.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) if k else pa.array(list(c), pa.int64()) for c, k in zip(cols, kinds, strict=True)], names=names)


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Segments of the placed rows, of so many at most. What a row has to know of others comes as marks of its place: that its role and text are the first of
    their kind, that it begins or ends its conversation."""
    first = rows.groupBy("conv_id", "role", "key").agg(F.min("place").alias("place")).select("place", F.lit("first").alias("kind"))
    ends = rows.groupBy("conv_id").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    ends = ends.select(F.inline(F.array(F.struct(F.col("a").alias("place"), F.lit("begins").alias("kind")), F.struct(F.col("b").alias("place"), F.lit("ends").alias("kind")))))
    none = lambda df: df.select("place", "kind", F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("fault"))
    marked = rows.select("place", F.lit("row").alias("kind"), "conv_id", "role", "fault").unionByName(none(first)).unionByName(none(ends))
    # "row" is the last of the kinds in the alphabet.
    marked = marked.repartitionByRange(partitions(rows.sparkSession), "place").sortWithinPartitions("place", "kind")
    return materialize(marked.mapInArrow(_segments(size), _SEGMENT.format("long")), "repair-segments")


def chosen(found: DataFrame) -> DataFrame:
    """(place, entry, exit, cost) of each segment. Conversations of one segment have one path; for others costs and ranks go through the segments in order, and
    a pass backwards picks the states."""
    whole = found.filter("begins AND ends").select("place", F.inline("paths")).select("place", "entry", "exit", "cost")
    parts = found.filter("NOT (begins AND ends)")
    # The rank of an audit among those of its segment and entry: all that later segments have to know of it.
    each = parts.select("conv_id", "place", F.inline("paths")).withColumn("rank", F.rank().over(Window.partitionBy("place", "entry").orderBy("audit")))
    costs = each.groupBy("conv_id", "place").agg(F.collect_list(F.struct("entry", "exit", "cost", "rank")).alias("paths"))

    def run(key, table):
        table = table.sort_by("place")
        best, back, marks = {START: (0, 0)}, [], []  # state: (cost, rank of its audit)
        for paths in table["paths"].to_pylist():
            found = {}
            for p in paths:
                if p["entry"] in best:
                    cost, rank = best[p["entry"]]
                    option = (cost + p["cost"], (rank, p["rank"]), p["entry"], p["cost"])
                    if p["exit"] not in found or option < found[p["exit"]]:
                        found[p["exit"]] = option
            ranks = {x: r for r, x in enumerate(sorted({o[1] for o in found.values()}))}
            best = {state: (o[0], ranks[o[1]]) for state, o in found.items()}
            back.append({state: (o[2], o[3]) for state, o in found.items()})
        state = min(best, key=lambda s: best[s])
        for steps in reversed(back):
            entry, cost = steps[state]
            marks.append((entry, state, cost))
            state = entry
        marks.reverse()
        return pa.table({"place": table["place"], "entry": pa.array([m[0] for m in marks], pa.int32()), "exit": pa.array([m[1] for m in marks], pa.int32()), "cost": pa.array([m[2] for m in marks], pa.int64())})

    return whole.unionByName(costs.groupBy("conv_id").applyInArrow(run, "place long, entry int, exit int, cost long"))


def _edits(batches):
    """Segments with their audit -> (conv_id, place, kind, line or role): what stands in front of a row's place, and what becomes of it."""
    for batch in batches:
        out = []
        for conv, places, initials, entry, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            inserted: list[str] = []
            for k, letter, role in apply(entry, initials, audit):
                if letter == "I":
                    inserted.append(role)
                else:
                    out.append((conv, places[k], 0, letter, role, inserted))
                    inserted = []
            if inserted:
                out.append((conv, places[-1], 2, "I", "", inserted))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "place", "kind", "edit", "role", "inserted"])


def _digests(batches):
    """(conv_id, place, kind, edit, role, inserted, text) in order, an edit in front of its row -> the hash of the repaired lines."""
    out, conv, digest, lines, edit = [], None, None, 0, None

    def add(line: str):
        nonlocal lines
        digest.update((("\n" if lines else "") + line).encode("utf-8", "surrogatepass"))
        lines += 1

    for batch in batches:
        for c, kind, letter, role, inserted, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if digest is None or c != conv:
                if digest is not None:
                    out.append((conv, digest.hexdigest(), lines))
                conv, digest, lines, edit = c, hashlib.sha256(), 0, None
            if kind == 1:
                if edit[0] != "D":
                    add(f"{edit[1] or role}:{text}")
                continue
            for r in inserted:
                add(f"{r}:")
            edit = (letter, role)
        if len(out) >= ROWS:
            yield _hashed(out)
            out = []
    if digest is not None:
        out.append((conv, digest.hexdigest(), lines))
    yield _hashed(out)


def _hashed(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "repaired_sha256", "repaired_rows"])


def edited(rows: DataFrame, found: DataFrame, picked: DataFrame) -> DataFrame:
    """The stream of repaired lines as rows: edits (kind 0), texts (1) and what stands behind the last row (2)."""
    path = F.filter("paths", lambda p: (p["entry"] == F.col("entry")) & (p["exit"] == F.col("exit")))[0]
    edits = found.join(picked, "place").select("conv_id", "places", "initials", "entry", path["audit"].alias("audit")).mapInArrow(lean(_edits), "conv_id long, place long, kind int, edit string, role string, inserted array<string>")
    texts = rows.select("conv_id", "place", F.lit(1).alias("kind"), F.lit("").alias("edit"), "role", F.array().cast("array<string>").alias("inserted"), "text")
    return texts.unionByName(edits.withColumn("text", F.lit("")))


def repair(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Of turns(conv_id, turn, role, text) as they are, per conversation: gaps, counts of faults and of illegal neighbours, the cost and audit of the
    cheapest repair and the hash of what it makes."""
    rows = placed(turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")))
    found = segments(rows, segment)
    picked = materialize(chosen(found), "repair-chosen")
    lines = edited(rows, found, picked).repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind")
    hashed = lines.select("conv_id", "kind", "edit", "role", "inserted", "text").mapInArrow(lean(_digests), "conv_id long, repaired_sha256 string, repaired_rows long")
    per_turn = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    gaps = per_turn.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    path = F.filter("paths", lambda p: (p["entry"] == F.col("entry")) & (p["exit"] == F.col("exit")))[0]
    by_place = Window.partitionBy("conv_id").orderBy("place")
    parts = found.join(picked, "place").select("conv_id", "place", "blank", "duplicate", "truncated", "wrong", F.element_at("initials", 1).alias("head"), F.element_at("initials", -1).alias("tail"), path.alias("path"))
    parts = parts.withColumn("seam", F.concat(F.lag("tail").over(by_place), "head"))  # of a conversation, a row for each segment
    total = parts.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("wrong") + F.count_if(~F.col("seam").isin(*LEGAL))).alias("illegal"), F.sum("path.cost").alias("cost"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("place", F.col("path.audit").alias("audit")))), lambda x: x["audit"])).alias("audit"),
    )
    on = lambda df, name: df.withColumnRenamed("conv_id", name)
    same = lambda name: F.col("conv_id").eqNullSafe(F.col(name))
    out = total.join(on(gaps, "g"), same("g")).join(on(hashed, "h"), same("h"))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; those without a row after the damage have zeros."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    fixed = repair(damaged(turns)).withColumnRenamed("conv_id", "c")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    out = turns.select("conv_id").distinct().join(fixed, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
