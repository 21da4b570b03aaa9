"""Attempt limiting with a window that starts at the first attempt of a key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.ranks import numbered
from tidemark.session import land

WINDOW_SECONDS = 900
MAX_ATTEMPTS = 5
BUCKET = 4_096      # attempts of a key that a task walks at once

OUT = "key string, event_id bigint, at_us bigint, count bigint, blocked boolean"


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def step(state, at_us, success, window_us, limit):
    """state is (start, count) or None; returns (state, count, blocked) after one attempt."""
    if state is None or at_us >= state[0] + window_us:
        state = (at_us, 0)
    count = state[1] + 1
    blocked = count > limit
    return (None if success and not blocked else (state[0], count)), count, blocked


def _next_starts(rows: DataFrame, window_us: int, limit: int) -> DataFrame:
    """rows (key, idx, at_us, success, ...) with next, the attempt that starts the window after one that
    starts here; past the last attempt if none does.

    A window ends with the first attempt a full window later, or, if earlier, with a success among its
    first `limit` attempts. That depends on the starting attempt alone, not on how it came to start.
    """
    # an attempt's end of window among the attempts in time order: those before it, and as many ends
    # of windows as attempts before this one, since ends come in the order of starts
    marks = rows.select("key", F.col("at_us").alias("when"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("of"))
    ends = rows.select("key", (F.col("at_us") + window_us).alias("when"), F.lit(0).alias("kind"), F.col("idx").alias("of"))
    places = numbered(marks.unionByName(ends), "key", ["when", "kind", "of"], "place").where("kind = 0")
    timed = places.select("key", F.col("of").alias("idx"), (F.col("place") - F.col("of")).alias("late"))
    # a success closes the windows of the attempts shortly before it
    back = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("idx") - limit + 1), F.col("idx")))
    wins = rows.where("success").select("key", F.col("idx").alias("won"), back.alias("idx"))
    wins = wins.groupBy("key", "idx").agg(F.min("won").alias("won"))
    joined = rows.join(timed, ["key", "idx"]).join(wins, ["key", "idx"], "left")
    return joined.withColumn("next", F.when(F.col("won") < F.col("late"), F.col("won") + 1).otherwise(
        F.col("late"))).drop("late", "won")


def _exits(group):
    """A bucket's attempts with leaves: where the windows lead that start here, past the bucket."""
    import pyarrow as pa

    group = group.sort_by("idx")
    base, onward = group["idx"][0].as_py(), group["next"].to_pylist()
    for i in range(len(onward) - 1, -1, -1):
        inside = onward[i] - base
        if inside < len(onward):
            onward[i] = onward[inside]
    return group.append_column("leaves", pa.array(onward, pa.int64()))


def _starts(group):
    """A bucket's attempts with start, the last one that starts a window, once one did."""
    import pyarrow as pa

    group = group.sort_by("idx")
    base, onward, entry = group["idx"][0].as_py(), group["next"].to_pylist(), group["entry"][0].as_py()
    starts = [None] * len(onward)
    while entry is not None and entry - base < len(onward):
        upto = min(onward[entry - base] - base, len(onward))
        starts[entry - base:upto] = [entry] * (upto - entry + base)
        entry = onward[entry - base]
    return group.drop_columns(["next", "entry"]).append_column("start", pa.array(starts, pa.int64()))


def _visited(jumps: DataFrame, first: DataFrame) -> DataFrame:
    """Nodes that jumps (key, node, to) reach from first (key, node), by jumps that double in length."""
    reached, jumps = land(first, "reached"), land(jumps, "jumps")
    while not jumps.isEmpty():
        more = reached.join(jumps, ["key", "node"]).select("key", F.col("to").alias("node"))
        reached = land(reached.unionByName(more), "reached")
        ahead = jumps.select("key", F.col("node").alias("to"), F.col("to").alias("then"))
        jumps = land(jumps.join(ahead, ["key", "to"]).select("key", "node", F.col("then").alias("to")), "jumps")
    return reached


def limit_attempts(attempts: DataFrame, window_seconds: int = WINDOW_SECONDS,
                   limit: int = MAX_ATTEMPTS, bucket: int = BUCKET) -> DataFrame:
    """Count and verdict of every attempt. Columns: key, ts, event_id, success.

    Where the next window starts is a function of where one starts, so the windows of a key are a
    chain of jumps. Attempts are numbered and cut into buckets of equal size; a task maps each entry of
    its bucket to its exit, and the maps, restricted to entries that some exit meets, are composed
    along the buckets by doubling. A key that never pauses is thus spread like any other. Attempts
    without key are left out; null success is none; repeated rows are attempts of their own.
    """
    rows = attempts.where("key is not null").select(
        "key", F.col("event_id").cast("long").alias("event_id"), F.coalesce("success", F.lit(False)).alias("success"),
        _micros("ts").alias("at_us"))
    rows = land(numbered(rows, "key", ["at_us", "event_id"]), "attempts")
    rows = land(_next_starts(rows, window_seconds * 1_000_000, limit), "next-starts")
    rows = rows.withColumn("bucket", F.call_function("div", F.col("idx"), F.lit(bucket)))
    mapped = land(rows.select("key", "bucket", "idx", "next").groupBy("key", "bucket").applyInArrow(
        _exits, "key string, bucket long, idx long, next long, leaves long"), "bucket-maps")
    first = mapped.where("idx = 0").select("key", F.col("idx").alias("node"))
    entries = mapped.select("key", F.col("leaves").alias("node")).unionByName(first).distinct()
    jumps = mapped.select("key", F.col("idx").alias("node"), F.col("leaves").alias("to")).join(entries, ["key", "node"])
    inside = jumps.join(mapped.select("key", F.col("idx").alias("to")), ["key", "to"], "left_semi")
    visited = _visited(inside, first)
    entry = visited.select("key", F.call_function("div", F.col("node"), F.lit(bucket)).alias("bucket"),
                           F.col("node").alias("entry"))
    entry = entry.groupBy("key", "bucket").agg(F.min("entry").alias("entry"))
    walked = rows.select("key", "bucket", "idx", "event_id", "at_us", "next").join(entry, ["key", "bucket"], "left")
    walked = land(walked.groupBy("key", "bucket").applyInArrow(
        _starts, "key string, bucket long, idx long, event_id long, at_us long, start long"), "window-starts")
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = walked.groupBy("key", "bucket").agg(F.max("start").alias("start")).withColumn(
        "carried", F.max("start").over(before)).drop("start")
    count = F.col("idx") - F.coalesce("start", "carried") + 1
    return walked.join(carried, ["key", "bucket"]).select(
        "key", "event_id", "at_us", count.alias("count"),
        (count > limit).alias("blocked"))


def limit_attempts_stream(attempts: DataFrame, window_seconds: int = WINDOW_SECONDS,
                          limit: int = MAX_ATTEMPTS, watermark: str = "1 minute") -> DataFrame:
    """The same rule on a stream: one small state per key, dropped when its window has passed.

    Needs the RocksDB state store provider. Attempts of one micro-batch are applied in time
    order; rows later than the watermark are dropped.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql.types import LongType, StructField, StructType

    window_us = window_seconds * 1_000_000
    fold = step

    class Limiter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            fields = [StructField("start", LongType()), StructField("count", LongType())]
            self.window = handle.getValueState("window", StructType(fields))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
            state = tuple(self.window.get()) if self.window.exists() else None
            pdf = pd.concat(list(rows)).sort_values(["at_us", "event_id"])
            out = []
            for event_id, at_us, success in pdf[["event_id", "at_us", "success"]].itertuples(
                index=False
            ):
                state, count, blocked = fold(state, int(at_us), bool(success), window_us, limit)
                out.append((key[0], int(event_id), int(at_us), count, blocked))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state is None:
                self.window.clear()
            else:
                self.window.update(state)
                self.handle.registerTimer((state[0] + window_us) // 1000)
            yield pd.DataFrame(out, columns=["key", "event_id", "at_us", "count", "blocked"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.window.clear()
            yield pd.DataFrame(columns=["key", "event_id", "at_us", "count", "blocked"])

        def close(self) -> None:
            pass

    timed = attempts.withColumn("seen", F.col("ts").cast("timestamp")).withWatermark(
        "seen", watermark
    ).select("key", "event_id", "success", "seen", _micros("ts").alias("at_us"))
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Limiter(), outputStructType=OUT, outputMode="Append",
        timeMode="EventTime",
    )
