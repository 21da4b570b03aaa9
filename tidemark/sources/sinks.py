"""Durable outputs: trade log, equity curve and sector-median snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.statements import read_or_empty
from tidemark import schemas

LOG_VALUES = (
    "quantity", "execution_price", "wacc", "beta", "conviction_score", "altman_z_score",
    "var_95", "cvar_95",
)


def trade_log_rows(fills: DataFrame) -> DataFrame:
    """Shape rows for the log; portfolio risk figures stay null on single trades."""
    for c in LOG_VALUES:
        if c not in fills.columns:
            fills = fills.withColumn(c, F.lit(None))
    single = F.col("action") != "RISK_SNAPSHOT"
    risk = {c: F.when(~single, F.col(c).cast("double")) for c in ("var_95", "cvar_95")}
    return fills.select(
        "ts", "ticker", "action",
        *[risk.get(c, F.col(c).cast("double")).alias(c) for c in LOG_VALUES],
    )


def append_trades(fills: DataFrame, path: str) -> None:
    trade_log_rows(fills).write.mode("append").parquet(path)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, schemas.TRADE_LOGS, mergeSchema="true")


def replace_curve(curve: DataFrame, path: str) -> None:
    curve.select("date", "strategy_value", "benchmark_value").write.mode("overwrite").parquet(path)


def read_curve(curve: DataFrame) -> DataFrame:
    return curve.select(
        "date", F.col("strategy_value").alias("strategy"),
        F.col("benchmark_value").alias("benchmark"),
    ).orderBy("date")


def median_snapshot(medians: DataFrame, valuations: DataFrame, rates: DataFrame,
                    generated_at, assumptions: dict | None = None) -> DataFrame:
    """One row per sector, carrying the run's totals and assumptions."""
    totals = valuations.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("universe_size"),
        F.count_if(F.col("skip_reason").isNull()).alias("tickers_used"),
    )
    a = assumptions or {}
    values = F.struct(
        F.lit(a.get("growth")).cast("double").alias("growth"),
        F.lit(a.get("margin")).cast("double").alias("margin"),
        F.lit(a.get("terminal_growth", 0.025)).cast("double").alias("terminal_growth"),
    )
    return medians.join(totals, "as_of").join(rates, "as_of").select(
        F.lit(generated_at).cast("timestamp_ntz").alias("generated_at"), "as_of",
        "universe_size", "tickers_used", F.col("risk_free").alias("risk_free_rate"),
        values.alias("assumptions"), "sector", F.col("sector_median").alias("median"),
        "sample_count",
    )


GENERATIONS = "generation string, generated_at timestamp_ntz, row_count bigint"


def publish_snapshot(snapshot: DataFrame, path: str) -> str | None:
    """Write one generation and then, in a single file, the marker that makes it visible.

    A run that dies while data files are committed leaves no marker, so readers never see part of a
    generation, and a repeated run has an id of its own. Returns that id; an empty snapshot has
    nothing to publish and gives None.
    """
    spark, generation = snapshot.sparkSession, uuid.uuid4().hex
    folder = f"{path}/data/generation={generation}"
    snapshot.write.parquet(folder)
    mark = spark.read.schema(snapshot.schema).parquet(folder).agg(
        F.lit(generation).alias("generation"), F.max("generated_at").alias("generated_at"),
        F.count(F.lit(1)).alias("row_count"))
    row = mark.first()
    if not row.row_count:
        return None
    spark.createDataFrame([row], GENERATIONS).coalesce(1).write.mode("append").parquet(
        f"{path}/generations")
    return generation


def newest_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of the newest marked generation, empty if there is none. The marker is read before the
    data files are listed, so all files of its generation are there."""
    marks = read_or_empty(spark, f"{path}/generations", GENERATIONS)
    newest = marks.agg(F.max(F.struct("generated_at", "generation")).alias("m")).first()["m"]
    if newest is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/data/generation={newest['generation']}")
