"""Dashboard-style reads over the trade log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import latest, lookup
from tidemark.plans.registry import query


@query()
def k2_paged_trades(t):
    """One page, newest first, with the total taken by its own aggregate."""
    trades = t.trade_logs.filter("action <> 'RISK_SNAPSHOT'")
    rows = lookup.page(
        trades.orderBy(F.desc("ts"), F.desc("event_id")), limit="75", offset="50"
    ).select("event_id", "ticker", "action", "quantity")
    return rows.withColumn("total", trades.agg(F.count(F.lit(1))).scalar())


@query()
def k2_page_fallback(t):
    """Invalid paging values fall back to the first fifty."""
    trades = t.trade_logs.filter("action <> 'RISK_SNAPSHOT'")
    ordered = trades.orderBy(F.desc("ts"), F.desc("event_id"))
    return lookup.page(ordered, limit=float("nan"), offset=float("inf")).select("event_id")


@query()
def k2_page_after_cursor(t):
    """The third page, each reached from the last row of the one before."""
    trades, keys, cursor = t.trade_logs.filter("action <> 'RISK_SNAPSHOT'"), ("ts", "event_id"), None
    for _ in range(2):
        cursor = lookup.cursor_of(lookup.page_after(trades, keys, cursor, "75"), keys)
    return lookup.page_after(trades, keys, cursor, "75").select("event_id", "ticker", "action", "quantity")


@query()
def w16_latest_trade(t):
    trades = t.trade_logs.filter("action <> 'RISK_SNAPSHOT'")
    return latest.latest_row(
        trades, ["ticker"], ["ts", "event_id"],
        ["event_id", "action", "quantity", "execution_price", "conviction_score"],
    )


@query()
def w16_latest_risk(t):
    return latest.latest_risk(t.trade_logs).withColumn("as_of", F.col("as_of").cast("date"))
