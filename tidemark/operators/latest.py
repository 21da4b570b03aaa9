"""Newest value per key, with an age limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest_fresh(df: DataFrame, keys, value: str, at: str, now: Column, ttl_seconds) -> DataFrame:
    """Newest non-null value no older than the limit; `at` and now are epoch seconds."""
    live = (F.col(at) > now - ttl_seconds) & (F.col(at) <= now)
    return df.filter(F.col(value).isNotNull() & live).groupBy(*keys).agg(
        F.max_by(value, at).alias(value), F.max(at).alias(at)
    )


def latest_row(df: DataFrame, keys, at, columns) -> DataFrame:
    """Whole newest row per key; `at` lists the ordering columns."""
    row = F.max_by(F.struct(*columns), F.struct(*at)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, "row.*")


def latest_risk(trade_logs: DataFrame) -> DataFrame:
    """Newest portfolio risk row; without figures it is reported as unavailable."""
    newest = trade_logs.filter(F.col("action") == "RISK_SNAPSHOT").agg(
        F.max_by(F.struct("ts", "var_95", "cvar_95"), F.struct("ts", "event_id")).alias("r")
    ).filter("r is not null").select("r.*")
    ok = F.col("var_95").isNotNull() & F.col("cvar_95").isNotNull()
    return newest.select(
        F.when(ok, "ok").otherwise("unavailable").alias("status"),
        F.when(ok, F.col("var_95")).alias("var_95"), F.when(ok, F.col("cvar_95")).alias("cvar_95"),
        F.col("ts").alias("as_of"),
    )
