"""Monthly bars, equity curves, forward returns and curve metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators import asof
from tidemark.session import land

DAYS_PER_YEAR = 365.25


def monthly_bars(prices: DataFrame, since=None, until=None, keys=("ticker",)) -> DataFrame:
    """Last close of each calendar month."""
    rows = prices.filter(F.col("close").isNotNull() & ~F.isnan("close"))
    if since is not None:
        rows = rows.filter(F.col("date") >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.filter(F.col("date") <= F.lit(until).cast("date"))
    return rows.groupBy(*keys, F.trunc("date", "MM").alias("month")).agg(
        F.max_by("close", "date").alias("close")
    )


def price_slice(prices: DataFrame, picks: DataFrame, benchmark: str) -> DataFrame:
    """Prices of the picks and of the benchmark, landed: all steps of a back-test read these alone."""
    index = prices.sparkSession.range(1).select(F.lit(benchmark).alias("ticker"))
    names = picks.select("ticker").unionByName(index)
    return land(prices.join(names, "ticker", "left_semi"), "price-slice")


def pick_bars(picks: DataFrame, prices: DataFrame, until) -> DataFrame:
    """Monthly bars of each pick from its own date on."""
    rows = (
        prices.filter(F.col("date") <= F.lit(until).cast("date"))
        .join(picks.select("ticker", "as_of"), "ticker").filter("date >= as_of")
    )
    return monthly_bars(rows, keys=("as_of", "ticker"))


def common_months(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Months every surviving pick and the benchmark share, with the benchmark's bar."""
    survivors = bars.groupBy("as_of").agg(F.count_distinct("ticker").alias("survivors"))
    have = bars.groupBy("as_of", "month").agg(F.count(F.lit(1)).alias("present"))
    return (
        have.join(survivors, "as_of").filter("present = survivors")
        .join(benchmark.select("as_of", "month", F.col("close").alias("benchmark_close")),
              ["as_of", "month"])
    )


def equity_curve(picks: DataFrame, prices: DataFrame, benchmark: str, dates, until,
                 start_value: float = 100_000.0) -> DataFrame:
    """Equal-weight buy and hold, normalised at the first common month per date.

    Picks without any bar are dropped and their weight goes to the others.
    """
    # A few bars per pick, read three times below: written once instead of joined three times.
    bars = land(pick_bars(picks, prices.filter(F.col("ticker") != benchmark), until), "bars")
    own = prices.filter(F.col("ticker") == benchmark).withColumn(
        "as_of", F.explode(F.array(*[F.lit(d).cast("date") for d in dates]))
    )
    bench = monthly_bars(
        own.filter((F.col("date") >= F.col("as_of")) & (F.col("date") <= F.lit(until).cast("date"))),
        keys=("as_of",),
    )
    months = common_months(bars, bench)
    rows = bars.join(months, ["as_of", "month"])
    first = Window.partitionBy("as_of", "ticker").orderBy("month")
    rows = rows.withColumns({
        "first_close": F.first("close").over(first),
        "first_benchmark": F.first("benchmark_close").over(first),
    })
    return rows.groupBy("as_of", "month").agg(
        F.sum(start_value / F.col("survivors") * (F.col("close") / F.col("first_close")))
        .alias("strategy"),
        F.max(start_value * (F.col("benchmark_close") / F.col("first_benchmark")))
        .alias("benchmark"),
        F.max("survivors").alias("survivors"),
    )


def dropped_picks(picks: DataFrame, prices: DataFrame, until) -> DataFrame:
    bars = pick_bars(picks, prices, until)
    return picks.select("as_of", "ticker").join(bars, ["as_of", "ticker"], "left_anti")


def forward_performance(prices: DataFrame, holdings: DataFrame, dates, until,
                        lookback_days: int = 10, exit_days: int = 5) -> DataFrame:
    """Entry as of each date against the newest close near `until`."""
    entry = asof.latest_within(prices, dates, "close", lookback_days)
    last = asof.latest_within(prices, [until], "close", exit_days)
    joined = holdings.select("ticker", "as_of").join(
        entry.select("ticker", "as_of", F.col("close").alias("entry_price"),
                     F.col("close_date").alias("entry_date")), ["ticker", "as_of"],
    ).join(
        last.select("ticker", F.col("close").alias("exit_price"),
                    F.col("close_date").alias("exit_date")), "ticker",
    )
    return joined.withColumn("total_return", ratio("exit_price", "entry_price") - 1)


def headline_returns(curve: DataFrame, performance: DataFrame, benchmark: DataFrame,
                     dates) -> DataFrame:
    """Curve ratio where a curve of two points exists, else the mean of the pick returns."""
    ends = curve.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by("strategy", "month").alias("s0"), F.max_by("strategy", "month").alias("s1"),
        F.min_by("benchmark", "month").alias("b0"), F.max_by("benchmark", "month").alias("b1"),
    )
    mean = performance.groupBy("as_of").agg(F.avg("total_return").alias("mean_return"))
    bench = benchmark.select("as_of", F.col("total_return").alias("bench_return"))
    grid = asof.date_grid(curve.sparkSession, dates)
    j = grid.join(ends, "as_of", "left").join(mean, "as_of", "left").join(bench, "as_of", "left")
    curved = F.coalesce((F.col("points") >= 2) & (F.col("s0") != 0), F.lit(False))
    own = F.when(curved, ratio("s1", "s0") - 1).otherwise(F.col("mean_return"))
    other = F.when(curved, ratio("b1", F.nullif("b0", F.lit(0.0))) - 1).otherwise(
        F.col("bench_return")
    )
    return j.select(
        "as_of", own.alias("portfolio_return"), other.alias("benchmark_return"),
        (own - other).alias("alpha"),
    )


def period_returns(curve: DataFrame, keys, at="date", values=("strategy", "benchmark")) -> DataFrame:
    """Simple and log return of each step; a non-positive base gives none."""
    w = Window.partitionBy(*keys).orderBy(at)
    out = curve
    for v in values:
        prev = F.lag(v).over(w)
        out = out.withColumn(f"{v}_prev", prev)
    cols = {}
    for v in values:
        ok = F.col(f"{v}_prev") > 0
        cols[f"{v}_return"] = F.when(ok, F.col(v) / F.col(f"{v}_prev") - 1)
        cols[f"{v}_log_return"] = F.when(ok & (F.col(v) > 0), F.log(F.col(v) / F.col(f"{v}_prev")))
    return out.withColumns(cols).drop(*[f"{v}_prev" for v in values])


def drawdowns(curve: DataFrame, keys, at="date", values=("strategy", "benchmark")) -> DataFrame:
    """Worst fall from the running peak, in percent."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    fall = {}
    for v in values:
        peak = F.max(v).over(w)
        fall[f"{v}_fall"] = F.when(peak > 0, (peak - F.col(v)) / peak).otherwise(F.lit(0.0))
    return curve.withColumns(fall).groupBy(*keys).agg(*[
        (F.greatest(F.max(f"{v}_fall"), F.lit(0.0)) * 100).alias(f"{v}_max_drawdown")
        for v in values
    ])


def win_rate(curve: DataFrame, keys, at="date") -> DataFrame:
    """Share of steps won. The two return series drop bad bases independently and are then
    compared by position, so positions can shift against each other."""
    r = period_returns(curve, keys, at)
    upto = Window.partitionBy(*keys).orderBy(at).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    numbered = r.withColumns({
        f"{v}_i": F.when(F.col(f"{v}_return").isNotNull(), F.count(f"{v}_return").over(upto))
        for v in ("strategy", "benchmark")
    })
    none = F.lit(None).cast("double")
    pair = F.array(
        F.struct(F.col("strategy_i").alias("i"), F.col("strategy_return").alias("s"),
                 none.alias("b")),
        F.struct(F.col("benchmark_i").alias("i"), none.alias("s"),
                 F.col("benchmark_return").alias("b")),
    )
    aligned = numbered.select(*keys, F.inline(pair)).filter("i is not null").groupBy(
        *keys, "i").agg(F.max("s").alias("s"), F.max("b").alias("b"))
    both = F.col("s").isNotNull() & F.col("b").isNotNull()
    return aligned.groupBy(*keys).agg(
        F.coalesce(
            ratio(F.count_if(F.col("s") > F.col("b")), F.count_if(both)) * 100, F.lit(0.0)
        ).alias("win_rate")
    )


def curve_metrics(curve: DataFrame, keys, at="date", risk_free: float = 0.045) -> DataFrame:
    """All dashboard figures per curve; fewer than two points give zeros."""
    keys = list(keys)
    r = period_returns(curve, keys, at)
    base = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.min(at).alias("t0"), F.max(at).alias("t1"),
        *[f(v, at).alias(f"{v}_{n}") for v in ("strategy", "benchmark")
          for f, n in ((F.min_by, "first"), (F.max_by, "last"))],
        F.stddev_samp("strategy_log_return").alias("step_vol"),
        F.count("strategy_log_return").alias("steps"),
    )
    days = F.datediff("t1", "t0").cast("double")
    years = F.greatest(days / DAYS_PER_YEAR, F.lit(1 / DAYS_PER_YEAR))
    gap = ratio(days, F.col("points") - 1)
    per_year = F.when(gap > 0, DAYS_PER_YEAR / gap).otherwise(F.lit(12.0))

    def growth(v) -> Column:
        return ratio(f"{v}_last", f"{v}_first")

    def total(v):
        return F.when(F.col(f"{v}_first") > 0, (growth(v) - 1) * 100).otherwise(F.lit(0.0))

    def annual(v):
        return F.when(
            F.col(f"{v}_first") > 0, (F.pow(growth(v), F.lit(1.0) / years) - 1) * 100
        ).otherwise(F.lit(0.0))

    vol = F.when(F.col("steps") >= 2, F.col("step_vol") * F.sqrt(per_year) * 100).otherwise(
        F.lit(0.0)
    )
    j = (
        base.withColumns({
            "strategy_total": total("strategy"), "benchmark_total": total("benchmark"),
            "strategy_annual": annual("strategy"), "benchmark_annual": annual("benchmark"),
            "volatility": vol,
        })
        .join(drawdowns(curve, keys, at), keys, "left").join(win_rate(curve, keys, at), keys, "left")
    )
    sharpe = F.when(
        F.col("volatility") > 0,
        (F.col("strategy_annual") / 100 - risk_free) / (F.col("volatility") / 100),
    ).otherwise(F.lit(0.0))
    figures = {
        "strategy_total": F.col("strategy_total"), "benchmark_total": F.col("benchmark_total"),
        "strategy_annual": F.col("strategy_annual"), "benchmark_annual": F.col("benchmark_annual"),
        "alpha": F.col("strategy_annual") - F.col("benchmark_annual"),
        "volatility": F.col("volatility"), "sharpe": sharpe,
        "max_drawdown": F.col("strategy_max_drawdown"),
        "benchmark_max_drawdown": F.col("benchmark_max_drawdown"),
        "win_rate": F.coalesce("win_rate", F.lit(0.0)),
    }
    enough = F.col("points") >= 2
    return j.select(*keys, "points", *[
        F.when(enough, c).otherwise(F.lit(0.0)).alias(n) for n, c in figures.items()
    ])
