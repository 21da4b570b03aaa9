"""Streaming forms of freshness, order resolution and the fill log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.orders import TERMINAL
from tidemark.sources.sinks import trade_log_rows


def latest_stream(df: DataFrame, key: str, value: str, at: str, ttl_seconds: int,
                  watermark: str = "1 minute") -> DataFrame:
    """Changes of what is shown for each key: key, value, at and shown.

    State is the newest non-null value of a key. A newer one is emitted with shown true; when the event
    clock has gone ttl_seconds past the one held, it is emitted with shown false and forgotten. at is a
    timestamp column. Rows without key are left out. Needs the RocksDB state store provider.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    kind = dict(df.dtypes)
    out = f"{key} {kind[key]}, {value} {kind[value]}, at_us bigint, shown boolean"
    life, names = ttl_seconds * 1_000_000, [key, value, "at_us", "shown"]

    class Newest(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getValueState("newest", f"value {kind[value]}, at_us bigint")

        def handleInputRows(self, key, rows, timerValues):
            held = tuple(self.held.get()) if self.held.exists() else None
            before = held
            for pdf in rows:                # one row of each piece can matter
                top = pdf.loc[pdf["at_us"].idxmax()]
                if held is None or int(top["at_us"]) > held[1]:
                    held = top["value"], int(top["at_us"])
            if held != before:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.held.update(held)
                self.handle.registerTimer((held[1] + life) // 1000)
                yield pd.DataFrame([(key[0], *held, True)], columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            held = tuple(self.held.get())
            self.held.clear()
            yield pd.DataFrame([(key[0], *held, False)], columns=names)

        def close(self) -> None:
            pass

    timed = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).withColumn(
        "seen", F.col(at).cast("timestamp")).withWatermark("seen", watermark).select(
        F.col(key), F.col(value).alias("value"), "seen", F.unix_micros("seen").alias("at_us"))
    return timed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Newest(), outputStructType=out, outputMode="Update", timeMode="EventTime")


def shown_at(changes: DataFrame, key: str, value: str, now_us: int, ttl_seconds: int) -> DataFrame:
    """key, value and at_us of what latest_stream shows at a time: the last change up to then, unless its
    value is forgotten or past its age."""
    past = changes.where(F.col("at_us") <= now_us)
    last = past.groupBy(key).agg(
        F.max_by(F.struct(value, "shown"), F.struct("at_us", ~F.col("shown"))).alias("last"), F.max("at_us").alias("at_us"))
    return last.where(F.col("last.shown") & (F.col("at_us") > now_us - ttl_seconds * 1_000_000)).select(
        key, f"last.{value}", "at_us")


def resolutions_stream(events: DataFrame, max_polls: int = 10, interval_seconds: float = 0.5,
                       watermark: str = "1 minute") -> DataFrame:
    """order_id, status, filled_qty, resolved and polls of each order, once, as orders.resolve_orders.

    State is an order's first event, its first terminal state and its last one, within the time that
    polling takes from the first event. The answer is given when the event clock has passed the terminal
    state, or the end of polling, so no earlier event can still come; later and repeated terminal states
    change nothing. Rows without order are left out. Needs the RocksDB state store provider.
    """
    import math

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    step = round(interval_seconds * 1_000_000)
    polling, columns = (max_polls - 1) * step, ["order_id", "status", "filled_qty", "resolved", "polls"]
    terminal = set(TERMINAL)

    class Resolver(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            one = "{0}_at bigint, {0}_id bigint, {0}_status string, {0}_qty double"
            self.order = handle.getValueState(
                "order", f"start bigint, given boolean, {one.format('done')}, {one.format('last')}")

        def handleInputRows(self, key, rows, timerValues):
            start, given, done, last = None, False, None, None
            if self.order.exists():
                s = tuple(self.order.get())
                start, given, done, last = s[0], s[1], s[2:6] if s[2] is not None else None, s[6:10]
            if not given:
                pieces = []
                for pdf in rows:
                    pieces += zip(pdf["at_us"].tolist(), pdf["event_id"].tolist(), pdf["status"].tolist(),
                                  pdf["filled_qty"].tolist())
                # an order has as many events as it has states
                start = min([p[0] for p in pieces] + ([] if start is None else [start]))
                for p in pieces:
                    if p[0] - start <= polling:
                        if last is None or p[:2] > last[:2]:
                            last = p
                        if p[2] in terminal and (done is None or p[:2] < done[:2]):
                            done = p
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer((done[0] if done else start + polling) // 1000 + 1)
                self.order.update((start, False, *(done or (None,) * 4), *last))
            yield pd.DataFrame(columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            s = tuple(self.order.get())
            start, given, done, last = s[0], s[1], s[2:6] if s[2] is not None else None, s[6:10]
            if given:               # repeated states can no longer come within polling
                self.order.clear()
                yield pd.DataFrame(columns=columns)
                return
            kept = done or last
            polls = math.ceil((kept[0] - start) / step) + 1 if done else max_polls
            self.order.update((start, True, *s[2:]))
            self.handle.registerTimer((start + polling) // 1000 + 2)
            yield pd.DataFrame([(key[0], kept[2], kept[3], done is not None, polls)], columns=columns)

        def close(self) -> None:
            pass

    timed = events.where("order_id is not null").withColumn("seen", F.col("ts").cast("timestamp")).withWatermark(
        "seen", watermark).select(
        F.col("order_id").cast("string").alias("order_id"), "status", F.col("filled_qty").cast("double").alias("filled_qty"),
        F.col("event_id").cast("long").alias("event_id"), "seen", F.unix_micros("seen").alias("at_us"))
    return timed.groupBy("order_id").transformWithStateInPandas(
        statefulProcessor=Resolver(), outputMode="Append", timeMode="EventTime",
        outputStructType="order_id string, status string, filled_qty double, resolved boolean, polls bigint")


def log_fills(fills: DataFrame, path: str, checkpoint: str):
    """Append confirmed fills and the risk rows of runs to the trade log. Each micro-batch owns one directory, which a
    replay overwrites, so a restart neither loses nor repeats rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = trade_log_rows(batch.filter((F.col("quantity") > 0) | (F.col("action") == "RISK_SNAPSHOT")))
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return fills.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()
