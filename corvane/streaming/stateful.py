"""Keyed state with timers: the latest tokens of each user, and the lives of a daemon that ends when it is idle.

Both write what changes in a batch, numbered by it, to path/updates; the newest row of each key is the result (``latest``). A run goes to the end of what
is there and stops; the next one on the same path goes on from the stored state. A batch that is done again after a failure replaces its own rows.
State is held by the store that state with timers asks for, in the checkpoint's folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Tokens that a user holds, and the hours that one lives, by the clock of the user's own tokens.
TOKENS, LIVES = 2, 6
IDLE, LATE = 3, "7 days"
HOUR = pd.Timedelta(hours=1)
#: Users of one key of the lives' state, a power of two.
USERS = 64


class Tokens(StatefulProcessor):
    """Holds the TOKENS latest of a user; writes each token as it comes, is evicted or ends. ``forget_ms``: a user's tokens are forgotten after so
    long without an input, by the wall clock, in a stream that doesn't end (one that waits for a clock has no end)."""

    OUT = "user_id long, event_id long, held boolean, live boolean"

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle) -> None:
        self.latest = handle.getListState("latest", "ts timestamp, event_id long, live boolean", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues):
        before = [(t, e, alive) for t, e, alive in self.latest.get()]
        known = {e for _, e, _ in before}
        came = [(t, e, True) for part in rows for t, e in zip(part["ts"], part["event_id"], strict=True) if e not in known]
        order = sorted([*before, *came], key=lambda x: (x[0], x[1]), reverse=True)
        # The newest is always held, so the user's clock is in the state.
        now, held = order[0][0], order[:TOKENS]
        held = [(t, e, t > now - LIVES * HOUR) for t, e, _ in held]
        self.latest.put(held)
        old = {e: alive for _, e, alive in before}
        out = [(e, True, alive) for _, e, alive in held if old.get(e) != alive or e not in old] + [(e, False, False) for _, e, _ in order[TOKENS:]]
        yield pd.DataFrame({"user_id": [int(key[0])] * len(out), "event_id": [int(o[0]) for o in out], "held": [o[1] for o in out], "live": [bool(o[2]) for o in out]})

    def close(self) -> None:
        pass


class Lives(StatefulProcessor):
    """Counts the lives of a group's users; a group is USERS users of neighbouring ids, so that what state costs for a key is paid once for all of them.
    Lives that late events may still join or lengthen are kept as (user, start, end, events), times in microseconds; a timer counts and forgets
    those of the group whose idle hours the watermark is past."""

    OUT = "user_id long, sessions long, events long"

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "user_id long, start long, last long, n long")
        self.ended = handle.getListState("ended", "user_id long, sessions long, events long")

    def _stored(self, state, names):
        return pd.DataFrame(list(state.get()), columns=names, dtype="int64")

    def _lives(self):
        return self._stored(self.open, ["user_id", "start", "last", "n"])

    def _keep(self, lives):
        had = list(self.handle.listTimers())
        due = [int(lives["last"].min()) // 1000 + IDLE * 3600_000] if len(lives) else []
        for t in had:
            if t not in due:
                self.handle.deleteTimer(t)
        for t in due:
            if t not in had:
                self.handle.registerTimer(t)
        if len(lives):
            self.open.put(list(lives.itertuples(index=False, name=None)))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues):
        lives, came = self._lives(), []
        for part in rows:
            came.append(part["user_id"].unique())
            lives = _joined(pd.concat([lives, pd.DataFrame({"user_id": part["user_id"], "start": part["at"], "last": part["at"], "n": 1})]))
        self._keep(lives)
        ended = self._stored(self.ended, ["user_id", "sessions", "events"]).set_index("user_id")
        found = lives.groupby("user_id").agg(sessions=("n", "size"), events=("n", "sum")).add(ended, fill_value=0)
        yield found.loc[pd.unique(np.concatenate(came))].astype("int64").reset_index()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """What ends is counted elsewhere from now on: no number changes, and no row is written."""
        lives = self._lives()
        over = lives["last"] + IDLE * 3600_000_000 <= timerValues.getCurrentWatermarkInMs() * 1000
        more = lives[over].groupby("user_id").agg(sessions=("n", "size"), events=("n", "sum"))
        ended = more.add(self._stored(self.ended, ["user_id", "sessions", "events"]).set_index("user_id"), fill_value=0).astype("int64")
        self.ended.put(list(ended.itertuples(name=None)))
        self._keep(lives[~over])
        yield from ()

    def close(self) -> None:
        pass


def _joined(lives: pd.DataFrame) -> pd.DataFrame:
    """Lives and single events of users, those that are less than IDLE hours apart as one."""
    lives = lives.sort_values(["user_id", "start", "last"], kind="stable", ignore_index=True)
    before = lives.groupby("user_id")["last"].cummax().shift(fill_value=0)
    new = (lives["user_id"] != lives["user_id"].shift()) | (lives["start"] - before >= IDLE * 3600_000_000)
    return lives.groupby(new.cumsum()).agg({"user_id": "first", "start": "first", "last": "max", "n": "sum"}).astype("int64")


def _run(stream: DataFrame, key: str, processor: StatefulProcessor, time: str, path: str) -> None:
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        changed = stream.groupBy(key).transformWithStateInPandas(processor, processor.OUT, "Update", time)

        def save(df, batch):
            df.write.mode("overwrite").parquet(f"{path}/updates/batch={batch}")

        q = changed.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def latest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The newest row of each key."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/updates")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")


def tokens(events: DataFrame, path: str) -> DataFrame:
    """(user_id, event_id, held, live) of a stream (user_id, event_id, ts) of tokens, after all that has come so far."""
    _run(events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", Tokens(), "None", path)
    return latest(events.sparkSession, path, Tokens.OUT, ["user_id", "event_id"])


def lives(events: DataFrame, path: str, late: str = LATE) -> DataFrame:
    """(user_id, sessions, events) of a stream (user_id, ts), after all that has come so far and was no later than ``late``."""
    ts = F.col("ts").cast("timestamp")
    group = F.call_function("shiftright", F.col("user_id"), F.lit(USERS.bit_length() - 1)).alias("group")
    rows = events.select("user_id", ts.alias("ts"), F.unix_micros(ts).alias("at"), group).withWatermark("ts", late)
    _run(rows, "group", Lives(), "EventTime", path)
    return latest(events.sparkSession, path, Lives.OUT, ["user_id"])
