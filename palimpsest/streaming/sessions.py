"""Sessions of a stream with state: batches of messages, the last messages, the reflections due.

A session's state is its number of messages, those of the batch begun, and the last ones; it is kept
by ``transformWithState`` in the stream's checkpoint, so that a restart goes on where the stream
stopped. Every trigger gives a row for each session that has new messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Messages of a batch, messages that are kept, and messages between reflections.
BATCH, LAST, EVERY = 10, 50, 50
OUTPUT = "session {key}, n long, last timestamp, reflect boolean, reflections int, batches array<struct<batch: long, first: long, ids: array<long>>>, recent array<long>"
#: The state store that such state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Sessions(StatefulProcessor):
    """State of a session: how many messages, the ids of the batch begun, and the last ids; forgotten ``keep_ms`` after its last message, by the stream's watermark."""

    def __init__(self, size: int = BATCH, last: int = LAST, every: int = EVERY, keep_ms: int | None = None):
        self.size, self.last, self.every, self.keep_ms = size, last, every, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long, at timestamp")
        self.begun = handle.getListState("begun", "id long")
        self.recent = handle.getListState("recent", "id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "id"])
        held = self.count.get() if self.count.exists() else None
        before, latest = held or (0, None)
        begun = [r[0] for r in self.begun.get()]
        recent = [r[0] for r in self.recent.get()]
        ids = [int(i) for i in new["id"]]
        n, batches = before + len(ids), []
        waiting = begun + ids
        whole = len(waiting) // self.size * self.size
        number = before // self.size  # complete batches so far: begun ones aren't among them
        for k in range(0, whole, self.size):
            batches.append(Row(batch=number + k // self.size, first=min(waiting[k : k + self.size]), ids=waiting[k : k + self.size]))
        at = new["ts"].max()
        at = at if latest is None else max(at, pd.Timestamp(latest))
        recent = (recent + ids)[-self.last :]
        self.count.update((n, at.to_pydatetime()))
        if self.keep_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(at.timestamp() * 1000) + self.keep_ms)
        self._put(self.begun, waiting[whole:])
        self._put(self.recent, recent)
        yield pd.DataFrame({
            "session": [key[0]], "n": [n], "last": [at], "reflect": [n >= self.every and n % self.every == 0], "reflections": [n // self.every - before // self.every],
            "batches": [[b.asDict() for b in batches]], "recent": [recent[::-1]],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.count, self.begun, self.recent):
            state.clear()
        return iter(())

    @staticmethod
    def _put(state, ids: list[int]) -> None:
        if ids:
            state.put([(i,) for i in ids])
        else:
            state.clear()

    def close(self) -> None:
        pass


def session_states(messages: DataFrame, session: str, id: str, ts: str = "ts", size: int = BATCH, last: int = LAST, every: int = EVERY, keep_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """A row for each session with new messages: its number of messages, its last time, whether that number calls for a
    reflection, how many were due since the row before, the batches that became complete, and its last ids, the latest first.

    Messages of a trigger are taken in the order of time and id; those of a later trigger count as later. Null sessions are one.
    With ``keep_ms``, a session without a message for so long, by the time of the messages, begins anew; ``late`` messages may come so late.
    """
    key = messages.schema[session].dataType.simpleString()
    rows = messages.select(F.col(session).alias("session"), F.col(id).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", late) if keep_ms else rows
    return rows.groupBy("session").transformWithStateInPandas(
        statefulProcessor=Sessions(size, last, every, keep_ms), outputStructType=OUTPUT.format(key=key), outputMode="Update", timeMode="EventTime" if keep_ms else "None",
    )


def run_sessions(spark: SparkSession, messages: DataFrame, sink: str, checkpoint: str, session: str, id: str, ts: str = "ts", **settings) -> None:
    """Everything there is by now, once; each trigger's rows go to a folder of its number, so that a repeated trigger replaces them."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/trigger={number}")

    try:
        stream = session_states(messages, session, id, ts, **settings).writeStream.foreachBatch(write).outputMode("update")
        stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


def batches_of(states: DataFrame) -> DataFrame:
    """session, batch, n and first of the complete batches (J2), as ``operators.store.batches`` has them."""
    return states.select("session", F.explode("batches").alias("b")).select("session", "b.batch", F.size("b.ids").cast("long").alias("n"), "b.first")


def latest_states(states: DataFrame) -> DataFrame:
    """Each session's row of the last trigger that had it."""
    columns = [c for c in states.columns if c not in ("session", "trigger")]
    return states.groupBy("session").agg(F.max_by(F.struct(*columns), "trigger").alias("s")).select("session", "s.*")


def last_messages(states: DataFrame) -> DataFrame:
    """session and id of the last messages (J5), as ``operators.store.last_n`` has them."""
    return latest_states(states).select("session", F.explode("recent").alias("id"))
