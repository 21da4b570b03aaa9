"""Stateful behaviour: attempt limits, freshness, order resolution and the fill log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import latest, orders
from tidemark.plans.planning import POLL_SECONDS
from tidemark.plans.registry import query
from tidemark.session import shared_dir
from tidemark.streaming import attempts, flows


@query()
def t1_attempt_limit(t):
    """A one-day window, so that the sparse events reach the limit."""
    return attempts.limit_attempts(t.access_events, window_seconds=86_400)


@query()
def t2_latest_fresh(t):
    e = t.raw("events")
    seen = F.unix_seconds(F.col("ts").cast("timestamp"))
    value = F.when(F.col("event_type") != "view", F.col("value"))
    rows = e.select("user_id", value.alias("value"), seen.alias("seen_at"))
    now = F.lit(1706572800)  # 2024-01-30 00:00 UTC
    return latest.latest_fresh(rows, ["user_id"], "value", "seen_at", now, 43_200)


@query()
def t3_order_resolution(t):
    return orders.resolve_orders(t.order_events, interval_seconds=POLL_SECONDS).select(
        "order_id", "status", "filled_qty", "resolved", F.col("polls").cast("bigint").alias("polls")
    )


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOW, TTL = 1_706_572_800, 43_200     # 2024-01-30 00:00 UTC


def caught_up(stream, name: str, mode: str = "append"):
    """Runs a stream until it has read what is there and returns the rows it has written."""
    spark = stream.sparkSession
    base, setting = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKS)

    def write(batch, batch_id):         # a replay overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch_id={batch_id}")

    try:
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows").select(stream.columns)


def as_stream(df, name: str):
    """The rows of df as a stream of the files they are written to."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query()
def t1_attempt_limit_stream(t):
    """The same limit kept while attempts stream in."""
    stream = as_stream(t.access_events, "attempts")
    return caught_up(attempts.limit_attempts_stream(stream, window_seconds=86_400), "limited")


@query()
def t2_latest_fresh_stream(t):
    """What a stream of the events up to a moment shows at it; that moment and all ages are whole seconds."""
    e = t.raw("events").where(F.unix_seconds(F.col("ts").cast("timestamp")) <= NOW)
    rows = e.where("event_type <> 'view'").select("user_id", "value", "ts")
    changes = caught_up(flows.latest_stream(as_stream(rows, "seen"), "user_id", "value", "ts", TTL), "shown", "update")
    end = NOW * 1_000_000 + 999_999         # the last microsecond of the second
    return flows.shown_at(changes, "user_id", "value", end, TTL).select(
        "user_id", "value", F.call_function("div", "at_us", F.lit(1_000_000)).alias("seen_at"))


@query()
def t3_order_resolution_stream(t):
    """Orders resolved as their events stream in; a last row moves the clock beyond all polling."""
    e = t.order_events.select("order_id", "status", "filled_qty", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    tick = e.agg(F.max("ts").alias("ts")).select(
        F.lit("").alias("order_id"), F.lit("new").alias("status"), F.lit(0.0).alias("filled_qty"),
        F.lit(0).alias("event_id"), (F.col("ts") + F.expr("interval 365 days")).alias("ts"))
    stream = as_stream(e.unionByName(tick), "order-events")
    return caught_up(flows.resolutions_stream(stream, interval_seconds=POLL_SECONDS), "resolved").where("order_id <> ''")


@query()
def t4_fill_log(t):
    """A stream over the event files, run until it has caught up, then read back.

    Sign-ups stand for the risk row that ends a run.
    """
    base = f"{shared_dir(t.spark)}/tidemark/fills-{uuid.uuid4().hex}"
    schema = t.raw("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(
        t.sf_dir
    )
    uid = F.col("user_id")
    risk = F.col("event_type") == "signup"
    single = F.concat(F.lit("S"), F.lpad((uid % 100).cast("string"), 5, "0"))
    fills = stream.select(
        "ts", F.when(risk, "PORTFOLIO").otherwise(single).alias("ticker"),
        F.when(risk, "RISK_SNAPSHOT").when(uid % 2 == 0, "BUY").otherwise("SELL").alias("action"),
        F.when(F.col("event_type").isin("purchase", "click"), F.col("value"))
        .otherwise(F.lit(0.0)).alias("quantity"),
        F.when(risk, 0.0).otherwise(50.0 + uid % 60).alias("execution_price"),
        (0.01 * (1 + uid % 5)).alias("var_95"),
    )
    flows.log_fills(fills, f"{base}/log", f"{base}/checkpoint").awaitTermination()
    from tidemark.sources.sinks import read_trades

    log = read_trades(t.spark, f"{base}/log")
    return log.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "ticker",
                      "action", "quantity", "execution_price", "wacc", "var_95")
