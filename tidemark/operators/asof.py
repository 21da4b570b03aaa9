"""As-of selection of prices, share counts, splits and rates.

A lookback window is a fixed number of days, so the (small) date grid is expanded to one
row per visible day and joined by equality on the date. Large price tables are therefore
never range-joined and never shuffled before their partial aggregation.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.params import ScanParams


def date_grid(spark: SparkSession, dates) -> DataFrame:
    values = F.array(*[F.lit(d).cast("date") for d in dates])
    return spark.range(1).select(F.explode(values).alias("as_of"))


def visible_days(grid: DataFrame, lookback_days: int) -> DataFrame:
    """(as_of, date) for every day within the lookback, both ends included."""
    days = F.sequence(F.date_sub("as_of", lookback_days), F.col("as_of"))
    return grid.select("as_of", F.explode(days).alias("date"))


def within_lookback(c: Column, dates, lookback_days: int) -> Column:
    """Plain range predicate over all windows, touching ones merged, so that it reaches the scan."""
    windows = []
    for day in sorted(date.fromisoformat(str(d)) for d in dates):
        low = day - timedelta(days=lookback_days)
        if windows and low <= windows[-1][1] + timedelta(days=1):
            low = windows.pop()[0]
        windows.append((low, day))
    out = F.lit(False)
    for low, high in windows:
        out = out | c.between(F.lit(low), F.lit(high))
    return out


def latest_within(quotes: DataFrame, dates, value: str, lookback_days: int,
                  keys=("ticker",)) -> DataFrame:
    """Last non-null value on or before each date, at most lookback_days old."""
    grid = date_grid(quotes.sparkSession, dates)
    hits = (
        quotes.filter(
            within_lookback(F.col("date"), dates, lookback_days)
            & F.col(value).isNotNull() & ~F.isnan(value)
        )
        .join(visible_days(grid, lookback_days), "date")
    )
    return hits.groupBy(*keys, "as_of").agg(
        F.max_by(value, "date").alias(value), F.max("date").alias(f"{value}_date")
    )


def as_of_price(prices: DataFrame, dates, p: ScanParams = ScanParams()) -> DataFrame:
    return latest_within(prices, dates, "close", p.price_lookback_days).select(
        "ticker", "as_of", F.col("close").alias("price"), F.col("close_date").alias("price_date")
    )


def as_of_price_dense(prices: DataFrame, requests: DataFrame, lookback_days: int) -> DataFrame:
    """As-of join for a dense (ticker, as_of) request table.

    Time is cut into buckets one lookback long. A quote can only serve its own bucket and
    the next one, so each goes to both and every window holds two lookbacks at most,
    however many rows the ticker has.
    """
    origin = F.lit("1970-01-01").cast("date")

    def bucket(c: Column) -> Column:
        return F.floor(F.datediff(c, origin) / F.lit(lookback_days + 1))

    q = prices.filter(F.col("close").isNotNull()).select(
        "ticker", "date", F.lit(0).alias("is_request"), "close", F.col("date").alias("seen"),
        F.explode(F.array(bucket(F.col("date")), bucket(F.col("date")) + 1)).alias("bucket"),
    )
    r = requests.select(
        "ticker", F.col("as_of").alias("date"), F.lit(1).alias("is_request"),
        F.lit(None).cast("double").alias("close"), F.lit(None).cast("date").alias("seen"),
        bucket(F.col("as_of")).alias("bucket"),
    )
    w = (
        Window.partitionBy("ticker", "bucket").orderBy("date", "is_request")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = q.unionByName(r).withColumns({
        "price": F.last("close", ignorenulls=True).over(w),
        "price_date": F.last("seen", ignorenulls=True).over(w),
    }).filter("is_request = 1")
    fresh = F.col("price_date") >= F.date_sub("date", lookback_days)
    return found.select(
        "ticker", F.col("date").alias("as_of"),
        F.when(fresh, F.col("price")).alias("price"),
        F.when(fresh, F.col("price_date")).alias("price_date"),
    )


def split_factor(splits: DataFrame, dates) -> DataFrame:
    """Product of the ratios of all splits strictly after each date."""
    grid = F.array(*[F.lit(d).cast("date") for d in dates])
    after = F.filter(grid, lambda d: F.col("date") > d)
    return (
        splits.filter(F.col("ratio").isNotNull() & ~F.isnan("ratio") & (F.col("ratio") != 0))
        .withColumn("as_of", F.explode(after))
        .groupBy("ticker", "as_of").agg(F.product("ratio").alias("split_factor"))
    )


def as_of_shares(shares: DataFrame, splits: DataFrame, companies: DataFrame, dates,
                 p: ScanParams = ScanParams()) -> DataFrame:
    """Split-adjusted share count within a year of the date, else today's count, flagged."""
    recent = latest_within(shares, dates, "shares", p.shares_lookback_days)
    universe = companies.select(
        "ticker", F.col("shares_outstanding").alias("shares_now"),
        F.explode(F.array(*[F.lit(d).cast("date") for d in dates])).alias("as_of"),
    )
    joined = universe.join(recent, ["ticker", "as_of"], "left").join(
        split_factor(splits, dates), ["ticker", "as_of"], "left"
    )
    adjusted = F.col("shares") * F.coalesce("split_factor", F.lit(1.0))
    return joined.select(
        "ticker", "as_of",
        F.coalesce(adjusted, "shares_now").alias("shares"),
        F.col("shares").isNull().alias("shares_approximated"),
    )


def risk_free(prices: DataFrame, dates, ticker="^RF", p: ScanParams = ScanParams()) -> DataFrame:
    """Yield as a fraction per date; every date gets a row, the fallback where none is quoted."""
    grid = date_grid(prices.sparkSession, dates)
    own = prices.filter(F.col("ticker") == ticker)
    found = latest_within(own, dates, "close", p.rf_lookback_days, keys=())
    return grid.join(found, "as_of", "left").select(
        "as_of",
        F.coalesce(F.col("close") / 100.0, F.lit(p.rf_fallback)).alias("risk_free"),
    )
