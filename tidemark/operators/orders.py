"""Order states, fills and duplicate guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# States after which an order no longer changes.
TERMINAL = (
    "filled", "canceled", "expired", "rejected", "done_for_day", "stopped", "suspended",
    "calculated",
)


def resolve_orders(events: DataFrame, max_polls: int = 10, interval_seconds: float = 0.5) -> DataFrame:
    """State of each order when polling stops: its first terminal one up to the last poll, else the
    last one seen. The first poll is at the order's first event."""
    from pyspark.sql import Window

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    step = round(interval_seconds * 1_000_000)
    since = at - F.min(at).over(Window.partitionBy("order_id"))
    seen = events.withColumn("since", since).filter(F.col("since") <= (max_polls - 1) * step)
    done = F.col("status").isin(*TERMINAL)
    state = F.struct("symbol", "side", "status", "filled_qty", "filled_avg_price", "since")
    order = F.struct("ts", "event_id")
    ends = seen.groupBy("order_id").agg(
        F.min_by(state, F.when(done, order)).alias("first_done"), F.max_by(state, order).alias("last"))
    kept = F.coalesce("first_done", "last")
    polls = F.when(F.col("first_done").isNotNull(), F.ceil(kept["since"] / step) + 1).otherwise(max_polls)
    return ends.select(
        "order_id", *[kept[c].alias(c) for c in (
            "symbol", "side", "status", "filled_qty", "filled_avg_price")],
        F.col("first_done").isNotNull().alias("resolved"), polls.cast("int").alias("polls"),
    )


def fill_label(kind: str) -> Column:
    """Outcome of one order; kind is 'liquidation' or 'rebalance'."""
    full, part = {
        "liquidation": ("LIQUIDATED", "PARTIALLY_LIQUIDATED"),
        "rebalance": ("ORDER FILLED", "PARTIALLY FILLED"),
    }[kind]
    qty = F.coalesce("filled_qty", F.lit(0.0))
    status = F.col("status")
    shown = F.concat(F.lit(" (qty="), F.format_number(qty, 2), F.lit(")"))
    return (
        F.when(status.isNull(), "UNKNOWN")
        .when(status == "rejected", "REJECTED")
        .when(status == "canceled", F.concat(F.lit("CANCELED"), shown))
        .when((status == "expired") & (qty <= 0), "EXPIRED (no fill)")
        .when(qty <= 0, F.concat(F.lit("PENDING (status="), status, F.lit(")")))
        .when(status == "filled", full)
        .when(status == "expired", F.concat(F.lit(f"{part} THEN EXPIRED"), shown))
        .otherwise(F.concat(F.lit(part), shown))
    )


def without_duplicates(plan: DataFrame, open_symbols: DataFrame, source_ok: bool = True) -> DataFrame:
    """Drop symbols with an open order; if the lookup failed nothing is safe to submit."""
    if not source_ok:
        return plan.filter(F.lit(False))
    return plan.join(open_symbols.select("symbol").distinct(), "symbol", "left_anti")


def confirmed_fills(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("filled_qty") > 0)
