"""Equity curves, curve metrics and the whole back-test."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import backtest as bt, scan
from tidemark.plans.registry import query
from tidemark.plans.scanning import scores
from tidemark.session import land

END = fx.LAST_DAY
EXIT_DAYS = 10


def landed_picks(t, n=10):
    """Ranked picks, written once: the curve, the returns and the drop list all read them."""
    return land(scan.top_picks(scores(t), n).select("ticker", "as_of", "sector", "beta",
                                                   "pick_rank", "conviction"), "picks")


def thinned_prices(t):
    """Every seventh name loses its prices after the dates, so picks can drop out."""
    gone = F.col("ticker").rlike("^S") & (F.substring("ticker", 2, 5).try_cast("int") % 7 == 3)
    return t.prices.filter(~(gone & (F.col("date") >= F.lit(fx.AS_OF[0]).cast("date"))))


@query()
def w6_monthly_bars(t):
    return bt.monthly_bars(t.company_prices)


@query()
def w7_equity_curve(t):
    return bt.equity_curve(landed_picks(t), thinned_prices(t), "IDX", fx.AS_OF, END)


@query()
def w7_dropped_picks(t):
    return bt.dropped_picks(landed_picks(t), thinned_prices(t), END)


@query()
def w8_forward_performance(t):
    held = t.companies.select(
        "ticker", F.explode(F.array(*[F.lit(d).cast("date") for d in fx.AS_OF])).alias("as_of")
    )
    return bt.forward_performance(t.company_prices, held, fx.AS_OF, END, exit_days=EXIT_DAYS)


@query()
def w9_max_drawdown(t):
    return bt.drawdowns(t.region_curves, ("ticker",))


@query()
def w10_period_returns(t):
    return bt.period_returns(t.region_curves, ("ticker",))


@query()
def w11_curve_metrics(t):
    return bt.curve_metrics(t.region_curves, ("ticker",))


@query()
def w12_win_rate(t):
    return bt.win_rate(t.region_curves, ("ticker",))


@query()
def j5_common_months(t):
    picks = landed_picks(t)
    prices = thinned_prices(t)
    bars = bt.pick_bars(picks, prices.filter("ticker <> 'IDX'"), END)
    dates = F.array(*[F.lit(d).cast("date") for d in fx.AS_OF])
    own = prices.filter("ticker = 'IDX'").withColumn("as_of", F.explode(dates))
    bench = bt.monthly_bars(own.filter("date >= as_of"), until=END, keys=("as_of",))
    return bt.common_months(bars, bench).select("as_of", "month", "survivors")


def backtest_summary(t, dates=fx.AS_OF):
    """Returns, alpha and dropped names per date."""
    picks = landed_picks(t)
    prices = bt.price_slice(thinned_prices(t), picks, "IDX")
    curve = land(bt.equity_curve(picks, prices, "IDX", dates, END), "curve")
    perf = bt.forward_performance(prices, picks, dates, END, exit_days=EXIT_DAYS)
    grid = picks.select("as_of").distinct().withColumn("ticker", F.lit("IDX"))
    bench = bt.forward_performance(prices, grid, dates, END, exit_days=EXIT_DAYS)
    heads = bt.headline_returns(curve, perf, bench, dates)
    dropped = bt.dropped_picks(picks, prices, END).groupBy("as_of").agg(
        F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("dropped")
    )
    count = picks.groupBy("as_of").agg(F.count(F.lit(1)).alias("picks"))
    return heads.join(count, "as_of", "left").join(dropped, "as_of", "left")


@query()
def a12_headline_returns(t):
    return backtest_summary(t).select("as_of", "portfolio_return", "benchmark_return", "alpha")


@query()
def p12_backtest(t):
    return backtest_summary(t)


@query()
def u1_shared_months(t):
    """Months in which every region and the index traded."""
    months = bt.monthly_bars(t.risk_prices).select("ticker", "month")
    out = months.filter("ticker = 'IDX'").select("month")
    for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"):
        out = out.intersect(months.filter(F.col("ticker") == f"R_{r}").select("month"))
    return out
