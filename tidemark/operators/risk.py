"""Returns, covariance, tail measures and simulated portfolio risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.numeric import first_reason, is_finite, ratio
from tidemark.operators.quantiles import grouped_quantile
from tidemark.params import RiskParams
from tidemark.session import land

# The two multipliers of the 32-bit mixing function.
MIX = (0x7FEB352D, 0x846CA68B)


def log_returns(prices: DataFrame, as_of=None, p: RiskParams = RiskParams()) -> DataFrame:
    """Daily log returns over the newest closes; a single close gives none.

    The row_number filter is pushed to the map side, so at most `lookback` rows per ticker
    and task are shuffled.
    """
    rows = prices.filter(F.col("close").isNotNull() & ~F.isnan("close") & (F.col("close") > 0))
    if as_of is not None:
        rows = rows.filter(F.col("date") <= F.lit(as_of).cast("date"))
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    recent = rows.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= p.lookback)
    prev = F.lead("close").over(newest)
    return recent.withColumn("r", F.log(F.col("close") / prev)).filter("r is not null").select(
        "ticker", "date", "r"
    )


def complete_dates(returns: DataFrame, keys=()) -> DataFrame:
    """Rows on dates that every series of the set has."""
    keys = list(keys)
    names = F.count_distinct("ticker").alias("series")
    days = returns.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("present"))
    if keys:
        full = days.join(returns.groupBy(*keys).agg(names), keys).filter("present = series")
    else:
        full = days.filter(F.col("present") == returns.agg(names).scalar())
    return returns.join(full.select(*keys, "date"), [*keys, "date"], "left_semi")


def return_stats(returns: DataFrame) -> DataFrame:
    return returns.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std")
    )


def mean_vector(returns: DataFrame) -> DataFrame:
    """Mean return of each name over the dates that all names share."""
    return complete_dates(returns).groupBy("ticker").agg(F.avg("r").alias("mean"))


def covariance(returns: DataFrame, names: DataFrame | None = None, block_names: int = 256,
               block_dates: int = 1024) -> DataFrame:
    """Sample covariance of all pairs (ticker_1 <= ticker_2) over the dates that all names share;
    names (ticker) restricts it to a subset first. returns has one row per ticker and date. One
    common date gives null.

    A centred series is one array per block of dates. Names fall into as many hash blocks as their
    number asks for, and each pair of name blocks and block of dates is one task with a partial
    product, so a task holds about 2 * block_names * block_dates numbers however large the table is,
    a series travels once per name block, and only partial products are summed.
    """
    import numpy as np
    import pandas as pd

    def product(key, pdf):
        low, high = int(key[0]), int(key[1])
        x = np.stack(pdf["x"].to_numpy())
        home, label = pdf["block"].to_numpy(), pdf["ticker"].to_numpy()
        left, right = np.flatnonzero(home == low), np.flatnonzero(home == high)
        first, second = np.repeat(label[left], right.size), np.tile(label[right], left.size)
        swap = first > second
        out = pd.DataFrame({
            "ticker_1": np.where(swap, second, first), "ticker_2": np.where(swap, first, second),
            "cell": (x[left] @ x[right].T).ravel(),
        })
        return out[~swap] if low == high else out

    if names is not None:
        returns = returns.join(names, "ticker", "left_semi")
    shared = land(complete_dates(returns).select("ticker", "date", "r"), "complete-dates")
    size = shared.agg(F.count_distinct("ticker").alias("names"),
                      F.count_distinct("date").alias("dates")).first()
    blocks, chunks = max(1, -(-size.names // block_names)), max(1, -(-size.dates // block_dates))
    block = F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int")
    chunk = F.pmod(F.xxhash64("date"), F.lit(chunks)).cast("int")
    means = shared.groupBy("ticker").agg(F.avg("r").alias("mean"))
    point = F.struct("date", (F.col("r") - F.col("mean")).alias("x"))
    vectors = shared.join(means, "ticker").groupBy("ticker", chunk.alias("chunk")).agg(
        F.array_sort(F.collect_list(point)).getField("x").alias("x"))
    partners = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(
        F.least(F.col("block"), o).alias("low"), F.greatest(F.col("block"), o).alias("high")))
    cells = vectors.withColumn("block", block).select("*", F.inline(partners)).groupBy(
        "low", "high", "chunk").applyInPandas(product, "ticker_1 string, ticker_2 string, cell double")
    if chunks > 1:
        cells = cells.groupBy("ticker_1", "ticker_2").agg(F.sum("cell").alias("cell"))
    return cells.select("ticker_1", "ticker_2",
                        ratio("cell", F.lit(float(size.dates - 1))).alias("covariance"))


def tail_risk(paths: DataFrame, keys, value: str, tail: float = 0.05) -> DataFrame:
    """Interpolated tail percentile and the mean of the outcomes at or below it; a group with
    a non-finite outcome is an error. paths is read more than once: land it if costly."""
    keys = list(keys)
    usable = F.when(is_finite(value), F.col(value))
    clean = paths.select(*keys, usable.alias("x"))
    var = grouped_quantile(clean, keys, "x", tail, "var_95")
    joined = clean.join(var.drop("sample_count"), keys, "left")
    below = F.when(F.col("x") <= F.col("var_95"), F.col("x"))
    out = joined.groupBy(*keys).agg(
        F.max("var_95").alias("var_95"), F.avg(below).alias("cvar_95"),
        F.bool_and(F.col("x").isNotNull()).alias("finite"),
    )
    good = F.col("finite")
    return out.select(
        *keys, F.when(good, "ok").otherwise("error").alias("status"),
        F.when(good, F.col("var_95")).alias("var_95"),
        F.when(good, F.coalesce("cvar_95", "var_95")).alias("cvar_95"),
    )


def held_returns(holdings: DataFrame, returns: DataFrame) -> DataFrame:
    """Returns of each holding, matched by name, on dates the whole portfolio shares."""
    j = holdings.select("portfolio_id", "ticker", "weight").join(returns, "ticker")
    return complete_dates(j, ("portfolio_id",))


def weight_policy(holdings: DataFrame, returns: DataFrame, overlap: DataFrame,
                  p: RiskParams = RiskParams()) -> DataFrame:
    """Per portfolio: priced share of the weight, common observations and the status ladder."""
    priced = returns.select("ticker").distinct().withColumn("priced", F.lit(True))
    j = holdings.join(priced, "ticker", "left")
    totals = j.groupBy("portfolio_id").agg(
        F.sum("weight").alias("total_weight"),
        F.sum(F.when(F.col("priced"), F.col("weight")).otherwise(F.lit(0.0)))
        .alias("priced_weight"),
        F.count_if(F.col("priced")).alias("priced_names"),
        F.bool_and(is_finite("weight")).alias("finite"),
        F.min("weight").alias("least_weight"),
    )
    common = overlap.groupBy("portfolio_id").agg(F.count_distinct("date").alias("observations"))
    rows = totals.join(common, "portfolio_id", "left").withColumn(
        "coverage", ratio("priced_weight", "total_weight")
    )
    problem = first_reason(
        (~F.col("finite"), "error:weights_not_finite"),
        (F.col("least_weight") < 0, "error:negative_weight"),
        (F.col("priced_names") == 0, "insufficient_data:no_history"),
        (F.coalesce("observations", F.lit(0)) < 2, "insufficient_data:no_overlap"),
        (F.col("priced_weight") <= 0, "insufficient_data:no_priced_weight"),
        (F.col("coverage") < p.min_coverage, "insufficient_data:low_coverage"),
    )
    return rows.select(
        "portfolio_id", "total_weight", "priced_weight", "priced_names", "coverage",
        F.coalesce("observations", F.lit(0).cast("bigint")).alias("observations"),
        F.coalesce(F.split_part(problem, F.lit(":"), F.lit(1)), F.lit("ok")).alias("status"),
        F.split_part(problem, F.lit(":"), F.lit(2)).alias("message"),
    )


def rescaled_weights(holdings: DataFrame, policy: DataFrame, returns: DataFrame) -> DataFrame:
    """Weights of the priced names, scaled back to the requested total."""
    priced = returns.select("ticker").distinct()
    ok = policy.filter("status = 'ok'").select("portfolio_id", "total_weight", "priced_weight")
    return holdings.join(priced, "ticker", "left_semi").join(ok, "portfolio_id").select(
        "portfolio_id", "ticker",
        (F.col("weight") * (F.col("total_weight") / F.col("priced_weight"))).alias("weight"),
    )


def mixed(x):
    """Well-mixed 32-bit numbers from an array of 32-bit numbers."""
    import numpy as np

    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(MIX[0])
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(MIX[1])
    return x ^ (x >> np.uint32(16))


def draws(seed: int, first: int, paths: int, days: int):
    """Standard normals by path and day. Each depends on the seed, its path and its day alone, so it
    is the same in whatever task, block or engine it is drawn: Box-Muller over two hashes."""
    import numpy as np

    numbers = np.arange(first, first + paths, dtype=np.int64) + int(mixed(np.array([seed], np.uint32))[0])
    path = mixed(numbers.astype(np.uint32))[:, None]
    day = mixed(np.arange(2 * days, dtype=np.uint32))[None, :]
    u, v = ((mixed(path ^ day[:, i::2]) + 0.5) / 2.0 ** 32 for i in (0, 1))
    return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * v)


def simulate_paths(weights: DataFrame, aligned: DataFrame, p: RiskParams = RiskParams()) -> DataFrame:
    """Simulated horizon return of every (portfolio, path).

    With X the centred T x N return matrix, z'X * sqrt(h/(T-1)) + h*mean has exactly the
    distribution of the sum of h correlated normal days. A path therefore needs only T
    shared normals, numbered by path and day, and each asset only its own column, sent once: no
    covariance matrix, no factorisation, and a portfolio of any width spreads over tasks.
    """
    import numpy as np
    import pandas as pd

    columns = aligned.groupBy("portfolio_id", "ticker").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("date", "r"))), lambda x: x["r"])
        .alias("series")
    )
    # A very wide portfolio is cut into slices of about p.slice names; their partial sums are
    # added by the aggregation below.
    slices = F.greatest(F.ceil(F.col("names") / p.slice), F.lit(1))
    width = weights.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("names"))
    work = (
        weights.join(columns, ["portfolio_id", "ticker"]).join(width, "portfolio_id")
        .withColumn("part", F.pmod(F.hash("ticker"), slices))
        .repartition("portfolio_id", "part")
    )
    sample = draws

    def run(batches):
        for pdf in batches:
            groups = [(portfolio, np.stack(rows["series"].to_numpy()), rows["weight"].to_numpy())
                      for portfolio, rows in pdf.groupby("portfolio_id", sort=False)]
            for first in range(0, p.simulations if groups else 0, p.block):
                size = min(p.block, p.simulations - first)
                z = sample(p.seed, first, size, max(x.shape[1] for _, x, _ in groups))
                for portfolio, x, weight in groups:
                    days, mean = x.shape[1], x.mean(axis=1)
                    spread = z[:, :days] @ (x - mean[:, None]).T * np.sqrt(p.horizon_days / (days - 1))
                    gain = np.expm1(spread + p.horizon_days * mean) @ weight
                    yield pd.DataFrame({"portfolio_id": portfolio, "path": first + np.arange(size, dtype=np.int64),
                                        "r": gain})

    parts = work.select("portfolio_id", "weight", "series").mapInPandas(
        run, "portfolio_id string, path bigint, r double"
    )
    return parts.groupBy("portfolio_id", "path").agg(F.sum("r").alias("r"))


def portfolio_var(holdings: DataFrame, prices: DataFrame, as_of=None,
                  p: RiskParams = RiskParams()) -> DataFrame:
    """Status, VaR and CVaR of every portfolio, refusing unrepresentative ones."""
    named = prices.join(holdings.select("ticker").distinct(), "ticker", "left_semi")
    returns = land(log_returns(named, as_of, p), "returns")
    aligned = land(held_returns(holdings, returns), "held-returns")
    policy = land(weight_policy(holdings, returns, aligned, p), "policy")
    weights = rescaled_weights(holdings, policy, returns)
    flat = aligned.groupBy("portfolio_id", "ticker").agg(F.stddev_samp("r").alias("sd")).groupBy(
        "portfolio_id").agg(F.max("sd").alias("widest"), F.count(F.lit(1)).alias("names"))
    paths = land(simulate_paths(weights, aligned, p), "paths")
    summary = tail_risk(paths, ("portfolio_id",), "r", p.tail).withColumnRenamed("status", "drawn")
    j = policy.join(summary, "portfolio_id", "left").join(flat, "portfolio_id", "left")
    still = (F.col("names") == 1) & (F.col("widest") <= 0)
    status = (
        F.when(F.col("status") != "ok", F.col("status")).when(still, "insufficient_data")
        .when(F.coalesce(F.col("drawn") == "ok", F.lit(False)), "ok").otherwise("error")
    )
    ok = F.col("outcome") == "ok"
    return j.withColumn("outcome", status).select(
        "portfolio_id", F.col("outcome").alias("status"),
        F.when(F.col("status") == "ok", F.when(still, "zero_variance")).otherwise(F.col("message"))
        .alias("message"),
        F.when(ok, F.col("var_95")).alias("var_95"), F.when(ok, F.col("cvar_95")).alias("cvar_95"),
    )
