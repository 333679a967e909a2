"""Streams of sessions with state against the batch operators, over a restart."""

from pyspark.sql import functions as F

from palimpsest.operators import store
from palimpsest.streaming import messages, sessions

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_sessions_of_a_stream_equal_those_of_a_table_after_a_restart(spark, tmp_path):
    events = spark.read.parquet(EVENTS).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    times = sorted(r["ts"] for r in events.select("ts").collect())
    edges = [times[len(times) // 4], times[len(times) // 2]]
    ordered = events.withColumn("part", (F.col("ts") > edges[0]).cast("int") + (F.col("ts") > edges[1]).cast("int"))
    folder, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    for parts in ([0, 1], [2]):  # the stream stops after two files, and goes on from its checkpoint with the third
        for part in parts:
            ordered.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)
        stream = messages.event_stream(spark, folder, events.schema, files=1)
        sessions.run_sessions(spark, stream, sink, checkpoint, "user_id", "event_id")
    states = spark.read.parquet(sink)
    assert states.select("trigger").distinct().count() == 3
    found = sorted(map(tuple, sessions.batches_of(states).collect()))
    want = store.batches(events, "user_id", 10, F.col("ts"), F.col("event_id")).groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first")).where("n = 10")
    assert found == sorted(map(tuple, want.collect()))
    last = store.last_n(events, "user_id", 50, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")
    assert sorted(map(tuple, sessions.last_messages(states).collect())) == sorted(map(tuple, last.collect()))
    now = sorted(map(tuple, sessions.latest_states(states).select("session", "last", "reflect").collect()))
    assert now == sorted(map(tuple, messages.activity(events, "user_id").collect()))
    due = events.groupBy("user_id").agg(F.floor(F.count(F.lit(1)) / 50).alias("n"))
    assert sorted(map(tuple, states.groupBy("session").agg(F.sum("reflections")).collect())) == sorted(map(tuple, due.collect()))


def test_a_session_that_was_silent_for_long_begins_anew(spark, tmp_path):
    folder, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "event_id long, user_id string, ts timestamp"
    for n, (user, hour) in enumerate((("a", 1), ("a", 2), ("b", 9), ("b", 10), ("a", 11))):
        rows = spark.range(7).select((F.col("id") + 7 * n).alias("event_id"), F.lit(user).alias("user_id"), F.lit(f"2024-01-01 {hour:02}:00:00").cast("timestamp").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(folder)
        sessions.run_sessions(spark, messages.event_stream(spark, folder, schema), sink, checkpoint, "user_id", "event_id", keep_ms=4 * 3_600_000)
    found = [(r["session"], r["n"]) for r in spark.read.parquet(sink).where("session IS NOT NULL").orderBy("last", "trigger").collect()]
    assert found == [("a", 7), ("a", 14), ("b", 7), ("b", 14), ("a", 7)]
