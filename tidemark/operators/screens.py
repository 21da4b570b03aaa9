"""Price-based screens. Only the newest N closes per ticker survive the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators.fundamentals import altman_z, f_score, quality_facts
from tidemark.functions.numeric import first_usable
from tidemark.params import GateParams


def recent_closes(prices: DataFrame, as_of, n: int, since=None) -> DataFrame:
    """The last n non-null closes up to the date, with age 1 = newest.

    row_number() <= n lets Spark cut each map partition to n rows per ticker before the
    shuffle, so a ticker with a very long history does not travel.
    """
    as_of = F.lit(as_of).cast("date")
    rows = prices.filter(
        F.col("close").isNotNull() & ~F.isnan("close") & (F.col("date") <= as_of)
    )
    if since is not None:
        rows = rows.filter(F.col("date") >= since)
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return rows.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def trend_filter(prices: DataFrame, as_of, g: GateParams = GateParams(), since=None) -> DataFrame:
    """Last close against the mean of exactly sma_window closes."""
    closes = recent_closes(prices, as_of, g.sma_window, since)
    stats = closes.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("closes"),
        F.avg("close").alias("sma"),
        F.max_by("close", "date").alias("last_close"),
    )
    ok = (
        (F.col("closes") == g.sma_window) & (F.col("sma") > 0)
        & (F.col("last_close") >= F.col("sma") * g.sma_tolerance)
    )
    return stats.withColumn("trend_ok", ok)


def wilder_rsi(prices: DataFrame, as_of, g: GateParams = GateParams(), since=None) -> DataFrame:
    """Wilder's smoothed index as one weighted sum.

    Change i of n carries weight r^(n-i)/p, except that the first p changes, averaged as
    the seed, all carry r^(n-p)/p, with r = (p-1)/p.
    """
    p = g.rsi_period
    as_of_col = F.lit(as_of).cast("date")
    if since is None:
        since = F.add_months(as_of_col, -g.rsi_months)
    rows = prices.filter(
        F.col("close").isNotNull() & ~F.isnan("close")
        & (F.col("date") <= as_of_col) & (F.col("date") >= since)
    )
    order = Window.partitionBy("ticker").orderBy("date")
    whole = Window.partitionBy("ticker")
    moves = rows.select(
        "ticker",
        (F.row_number().over(order) - 1).alias("i"),
        (F.count(F.lit(1)).over(whole) - 1).alias("n"),
        (F.col("close") - F.lag("close").over(order)).alias("move"),
    ).filter("i >= 1")
    keep = (p - 1) / p
    lag = F.when(F.col("i") <= p, F.col("n") - p).otherwise(F.col("n") - F.col("i"))
    weight = F.pow(F.lit(keep), lag) / p
    sums = moves.filter(F.col("n") >= p).groupBy("ticker").agg(
        F.sum(F.greatest("move", F.lit(0.0)) * weight).alias("gain"),
        F.sum(F.greatest(-F.col("move"), F.lit(0.0)) * weight).alias("loss"),
    )
    rsi = F.when(F.col("loss") == 0, F.lit(100.0)).otherwise(
        100.0 - 100.0 / (1.0 + ratio("gain", "loss"))
    )
    return sums.select("ticker", rsi.alias("rsi"))


def company_quotes(companies: DataFrame) -> DataFrame:
    return companies.select(
        "ticker",
        first_usable("last_price", "alt_price").alias("quote"),
        F.nullif("shares_outstanding", F.lit(0.0)).alias("shares_now"),
    )


def quality_scores(companies: DataFrame, statements: DataFrame, cuts) -> DataFrame:
    """Altman Z and Piotroski F from one pass over the statements."""
    facts = quality_facts(statements, cuts)
    return facts.join(company_quotes(companies), "ticker", "left").select(
        "ticker", "as_of", altman_z().alias("altman_z"), f_score().alias("f_score")
    )


def entry_signals(companies: DataFrame, statements: DataFrame, prices: DataFrame, as_of,
                  g: GateParams = GateParams(), sma_since=None) -> DataFrame:
    day = F.lit(as_of).cast("date")
    quality = quality_scores(companies, statements, [(as_of, as_of)])
    trend = trend_filter(prices, as_of, g, sma_since).select("ticker", "trend_ok")
    rsi = wilder_rsi(prices, as_of, g)
    return (
        companies.select("ticker", day.alias("as_of"))
        .join(quality, ["ticker", "as_of"], "left")
        .join(trend, "ticker", "left")
        .join(rsi, "ticker", "left")
    )


def altman_zone(z) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    return (
        F.when(z.isNull() | F.isnan(z), "N/A").when(z < 1.8, "Distress Zone")
        .when(z <= 2.99, "Grey Zone").otherwise("Safe Zone")
    )
