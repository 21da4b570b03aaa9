"""Scans, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import asof, scan
from tidemark.operators.orders import TERMINAL
from tidemark.plans.registry import query
from tidemark.session import shared_dir
from tidemark.sources import integrity, market, news, sinks, snapshots, statements as st


@query()
def s1_statements_long(t):
    """Wide statements (one column per period) unpivoted to one row per cell."""
    years = [f"{y}-12-31" for y in range(1995, 2001)]
    wide = (
        t.statements.withColumn("period", F.col("period_end").cast("string"))
        .groupBy("ticker", "statement", "line_item").pivot("period", years).agg(F.max("value"))
    )
    return st.to_long(wide)


@query()
def s2_current_price(t):
    return st.current_quotes(t.companies).select("ticker", "current_price")


@query()
def s3_current_shares(t):
    return st.current_quotes(t.companies).select("ticker", "shares_outstanding")


@query()
def s4_beta(t):
    held = t.positions.select(F.col("symbol").alias("ticker"))
    return held.join(st.current_quotes(t.companies).select("ticker", "beta"), "ticker", "left")


@query()
def s5_sector(t):
    return st.current_quotes(t.companies).select("ticker", "sector")


RECORD_MONEY = ("revenue", "ebit", "pretax", "tax_provision", "interest", "total_debt", "cash",
                "equity", "ocf", "capex")


@query(money=RECORD_MONEY)
def s6_company_records(t):
    return st.company_records(t.companies, t.statements, "2001-06-30")


@query()
def s7_normalise_tickers(t):
    messy = F.when(F.col("c_custkey") % 10 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit("  "), F.lower("c_name"), F.lit(" "))
    )
    return st.normalise_tickers(t.raw("customer").select("c_custkey", messy.alias("ticker")))


@query()
def s8_risk_free_rate(t):
    """Includes a date before any quote, which takes the fallback."""
    return asof.risk_free(t.macro_prices, [*fx.AS_OF, "1990-01-01"])


@query()
def s9_volatility_latest(t):
    return market.latest_close(t.macro_prices, "^VIX")


@query()
def s10_headlines(t):
    return news.headlines(t.news_raw)


@query()
def s11_search_feed(t):
    return news.search_feed(t.news_raw).withColumn(
        "published_at", F.unix_seconds("published_at")
    )


@query()
def s12_ticker_context(t):
    rate = asof.risk_free(t.macro_prices, [fx.LAST_DAY]).select("risk_free")
    vix = market.latest_close(t.macro_prices, "^VIX").select("close")
    macro = rate.withColumn("vix", vix.scalar())
    ctx = news.ticker_context(news.headlines(t.news_raw), macro)
    return ctx.select(
        "ticker", "risk_free", "vix",
        F.array_join(F.col("headlines.title"), "; ").alias("titles"),
    )


@query(money=("val",))
def s13_xbrl_scan(t):
    from tidemark.operators.facts import scan_facts

    return scan_facts(t.xbrl_facts_raw).select(
        "ticker", "tag", "form", "start", "end", "val", "accn", "filed"
    )


@query()
def s14_registrant_ids(t):
    return st.padded_ids(t.companies.select(
        F.lower("ticker").alias("ticker"), (1000 + F.col("universe_pos")).alias("cik")
    ))


@query(money=("value",))
def s15_snapshot_statements(t):
    return snapshots.to_statements(snapshots.parse(t.snapshots_raw))


@query()
def s16_trade_log_sink(t):
    """Written to the shared folder, then read back."""
    path = f"{shared_dir(t.spark)}/tidemark/trades-{uuid.uuid4().hex}"
    sinks.append_trades(t.trade_logs, path)
    back = sinks.read_trades(t.spark, path)
    return back.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


@query()
def s17_curve_sink(t):
    path = f"{shared_dir(t.spark)}/tidemark/curve-{uuid.uuid4().hex}"
    sinks.replace_curve(t.backtest_curve, path)
    return t.spark.read.parquet(path)


@query()
def s18_schema_evolution(t):
    old = t.trade_logs.filter(F.col("event_id") % 2 == 0).select("event_id", "ticker", "action")
    new = t.trade_logs.filter(F.col("event_id") % 2 == 1).select(
        "event_id", "ticker", "action", "altman_z_score", "var_95", "cvar_95"
    )
    return st.evolve(old, new)


@query()
def s19_curve_read(t):
    return sinks.read_curve(t.backtest_curve)


@query()
def s20_median_snapshot(t):
    from tidemark.plans.common import landed_valuations

    v = landed_valuations(t)
    rates = asof.risk_free(t.macro_prices, fx.AS_OF)
    snap = sinks.median_snapshot(scan.sector_medians(v), v, rates, "2001-07-01 00:00:00")
    path = f"{shared_dir(t.spark)}/tidemark/medians-{uuid.uuid4().hex}"
    sinks.publish_snapshot(snap, path)
    newest = sinks.newest_snapshot(t.spark, path, snap.schema)
    return newest.select(
        F.date_format("generated_at", "yyyy-MM-dd").alias("generated_day"), "as_of",
        "universe_size", "tickers_used", "risk_free_rate",
        F.col("assumptions.terminal_growth").alias("terminal_growth"), "sector", "median",
        "sample_count",
    )


@query()
def s21_hash_manifest(t):
    """Hashes of all document texts against a manifest with gaps, extras and errors."""
    d = t.raw("documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id"))
    actual = d.filter(F.col("doc_id") % 50 != 1).select(
        name.alias("name"), F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    )
    recorded = d.filter(F.col("doc_id") % 50 != 2).select(
        name.alias("name"),
        F.when(F.col("doc_id") % 50 == 3, F.lit("not-a-hash"))
        .when(F.col("doc_id") % 50 == 4, F.sha2(F.lit("other"), 256))
        .otherwise(F.sha2("text", 256)).alias("sha256"),
        (F.octet_length("text") + F.when(F.col("doc_id") % 50 == 5, 1).otherwise(0))
        .cast("bigint").alias("size_bytes"),
    )
    return integrity.verify_manifest(actual, recorded)


@query()
def s22_position_feed(t):
    p = t.positions
    text = F.when(F.col("current_price") % 7 == 0, F.lit("n/a")).otherwise(
        F.col("market_value").cast("int").cast("string")
    )
    gain = F.col("current_price") - F.col("avg_entry_price")
    raw = p.select(
        "symbol", F.col("qty").cast("string").alias("qty"), text.alias("market_value"),
        F.col("current_price").cast("string").alias("current_price"),
        F.col("avg_entry_price").cast("string").alias("avg_entry_price"),
        (gain * F.col("qty")).cast("string").alias("unrealized_pl"),
        (gain / F.col("avg_entry_price")).cast("string").alias("unrealized_plpc"),
    )
    return market.position_feed(raw)


@query()
def s23_open_order_symbols(t):
    return market.open_order_symbols(t.order_events, TERMINAL)


@query()
def s24_fresh_sentiment(t):
    """Newest headline per ticker, usable for 15 minutes."""
    from tidemark.operators.latest import latest_fresh

    feed = news.search_feed(t.news_raw)
    now = F.lit(1700000100 + 600)
    rows = feed.select("ticker", "title", F.unix_seconds("published_at").alias("seen_at"))
    return latest_fresh(rows, ["ticker"], "title", "seen_at", now, 900)


@query()
def s25_price_history(t):
    """Windows of three months and one year, counted per ticker."""
    prices = t.company_prices
    out = None
    for months in (3, 12):
        part = market.history_window(prices, "2001-06-30", months).groupBy("ticker").agg(
            F.lit(months).alias("months"), F.count(F.lit(1)).alias("closes"),
            F.min("date").alias("first_date"), F.max_by("close", "date").alias("last_close"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query()
def s26_snapshot_load(t):
    return snapshots.load_status(snapshots.parse(t.snapshots_raw))
