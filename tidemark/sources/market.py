"""Price-history windows, macro readings, positions and open orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def history_window(prices: DataFrame, as_of, months: int) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return prices.filter(
        (F.col("date") <= day) & (F.col("date") >= F.add_months(day, -months))
        & F.col("close").isNotNull()
    )


def latest_close(prices: DataFrame, ticker: str, as_of=None) -> DataFrame:
    rows = prices.filter((F.col("ticker") == ticker) & F.col("close").isNotNull())
    if as_of is not None:
        rows = rows.filter(F.col("date") <= F.lit(as_of).cast("date"))
    return rows.agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date"))


# Feed field -> output column.
POSITION_FIELDS = {
    "qty": "qty",
    "market_value": "marketValue",
    "current_price": "currentPrice",
    "avg_entry_price": "avgEntryPrice",
    "unrealized_pl": "unrealizedPl",
    "unrealized_plpc": "unrealizedPlPercent",
}


def position_feed(raw: DataFrame) -> DataFrame:
    """Numbers arrive as text; an unreadable one becomes null."""
    return raw.select(
        "symbol", *[F.col(c).try_cast("double").alias(n) for c, n in POSITION_FIELDS.items()]
    )


def open_order_symbols(orders: DataFrame, terminal) -> DataFrame:
    """Distinct symbols whose newest order state is not terminal."""
    last = orders.groupBy("order_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.max_by("symbol", F.struct("ts", "event_id")).alias("symbol"),
    )
    return last.filter(~F.col("status").isin(*terminal)).select("symbol").distinct()
