"""Put pricing, contract choice and hedge sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.normal import normal_cdf
from tidemark.functions.numeric import first_reason, is_finite, positive_whole, ratio
from tidemark.params import HedgeParams
from tidemark.session import land


def price_puts(df: DataFrame, prefix: str = "", spot: str = "spot") -> DataFrame:
    """Add d1, d2, put price and delta for columns spot, strike, years, rate, vol."""
    s, k, t, r, v = (F.col(c) for c in (spot, "strike", "years", "rate", "vol"))
    ok = (s > 0) & (k > 0) & (t > 0) & (v > 0)
    names = {n: f"{prefix}{n}" for n in ("d1", "d2", "put_price", "put_delta")}
    d1 = F.when(ok, (F.log(s / k) + (r + 0.5 * v * v) * t) / (v * F.sqrt(t)))
    out = df.withColumn(names["d1"], d1)
    out = out.withColumn(names["d2"], F.col(names["d1"]) - v * F.sqrt(t))
    out = out.withColumns({"__a": -F.col(names["d1"]), "__b": -F.col(names["d2"])})
    price = k * F.exp(-r * t) * normal_cdf("__b") - s * normal_cdf("__a")
    return out.withColumns({
        names["put_price"]: price, names["put_delta"]: normal_cdf(names["d1"]) - 1.0,
    }).drop("__a", "__b")


def stress_payoff(df: DataFrame, multiplier: int = 100) -> DataFrame:
    """Gain per contract when the spot falls by the stress fraction."""
    out = price_puts(df).withColumn("stressed_spot", F.col("spot") * (1 - F.col("stress")))
    out = price_puts(out, "stressed_", "stressed_spot")
    return out.withColumn(
        "payoff", (F.col("stressed_put_price") - F.col("put_price")) * multiplier
    ).drop("stressed_d1", "stressed_d2", "stressed_put_delta")


def contracts_needed(priced: DataFrame, p: HedgeParams = HedgeParams()) -> Column:
    """Contracts covering var_dollars, within budget and cap; any invalid input gives 0."""
    budget = F.col("budget")
    valid = (
        is_finite("var_dollars") & (F.col("var_dollars") > 0) & is_finite("spot")
        & (F.col("spot") > 0) & is_finite("strike") & (F.col("strike") > 0) & is_finite("vol")
        & (F.col("vol") > 0) & (F.col("vol") <= p.max_vol) & is_finite("rate")
        & (F.abs("rate") <= p.max_abs_rate) & (F.col("stress") > 0) & (F.col("stress") < 1)
        & positive_whole(F.col("days").cast("double")).isNotNull()
        & (budget.isNull() | (is_finite(budget) & (budget > 0) & (F.col("put_price") > 0)))
        & is_finite("payoff") & (F.col("payoff") > 0)
    )
    need = F.ceil(ratio("var_dollars", "payoff"))
    afford = F.floor(ratio(budget, F.col("put_price") * p.multiplier))
    sized = F.when(budget.isNull(), need).otherwise(F.least(need, afford))
    capped = F.greatest(F.least(sized, F.lit(p.max_contracts)), F.lit(0))
    return F.when(valid, capped).otherwise(F.lit(0)).cast("bigint")


def nearest_contract(chain: DataFrame, quotes: DataFrame, p: HedgeParams = HedgeParams()) -> DataFrame:
    """Contract closest to the target expiry, then to the spot, per (underlying, as_of).

    quotes has one row per underlying and date; ties keep chain order.
    """
    target = F.date_add("as_of", p.target_days)
    gap = F.abs(F.datediff("expiration_date", target))
    low = F.round(F.col("spot") * (1 - p.strike_band), 2)
    high = F.round(F.col("spot") * (1 + p.strike_band), 2)
    near = chain.filter("tradable").join(quotes, "underlying").filter(
        (gap <= p.window_days) & F.col("strike_price").between(low, high)
    )
    rank = F.struct(gap, F.abs(F.col("strike_price") - F.col("spot")), F.col("chain_pos"))
    row = F.min_by(F.struct("symbol", "expiration_date", "strike_price", "spot"), rank)
    return near.groupBy("underlying", "as_of").agg(row.alias("c")).select(
        "underlying", "as_of", "c.*"
    )


def hedge_exposure(positions: DataFrame, contracts: DataFrame, p: HedgeParams = HedgeParams()):
    """Held quantity and value of the chosen contract and of all other options on it."""
    held = positions.filter(
        (F.col("asset_class") == "us_option") & F.startswith("symbol", F.lit(p.underlying))
        & F.col("qty").isNotNull()
    ).select(F.col("symbol").alias("held"), "qty",
             F.coalesce("market_value", F.lit(0.0)).alias("held_value"),
             F.substring("symbol", 1, len(p.underlying)).alias("underlying"))
    j = held.join(contracts, "underlying")
    same = F.col("held") == F.col("symbol")
    zero = F.lit(0.0)
    return j.groupBy("underlying", "as_of").agg(
        F.sum(F.when(same, F.col("qty")).otherwise(zero)).alias("matching_qty"),
        F.sum(F.when(same, F.col("held_value")).otherwise(zero)).alias("matching_value"),
        F.sum(F.when(~same, F.col("qty")).otherwise(zero)).alias("other_qty"),
        F.sum(F.when(~same, F.col("held_value")).otherwise(zero)).alias("other_value"),
    )


def hedge_plan(requests: DataFrame, chain: DataFrame, quotes: DataFrame, positions: DataFrame,
               p: HedgeParams = HedgeParams()) -> DataFrame:
    """requests: portfolio_id, underlying, equity, var_dollars, buying_power (null = unknown).

    Every request gets a row; reason says why it has no contract: no_quote, no_contract or expired.
    The terms, one row per underlying and date, are written, so that Spark knows their size when all
    requests ask for the same underlying.
    """
    chosen = land(nearest_contract(chain, quotes, p), "contracts")
    terms = quotes.select("underlying", "as_of", F.col("spot").alias("quoted")).join(
        chosen, ["underlying", "as_of"], "left").join(
        hedge_exposure(positions, chosen, p), ["underlying", "as_of"], "left")
    j = requests.join(land(terms, "hedge-terms"), "underlying", "left")
    left_days = F.datediff("expiration_date", "as_of")
    j = j.withColumn("reason", first_reason(
        (~is_finite("quoted") | (F.col("quoted") <= 0), "no_quote"),
        (F.col("symbol").isNull(), "no_contract"), (left_days <= 0, "expired")))
    spent = F.coalesce(F.col("matching_value") + F.col("other_value"), F.lit(0.0))
    own = F.when(F.col("equity") != 0, F.greatest(
        F.col("equity") * p.budget_fraction - spent, F.lit(0.0)))
    rows = j.withColumns({
        "days": F.datediff("expiration_date", "as_of"),
        "budget": F.when(F.col("buying_power").isNull(), own).otherwise(
            F.least(own, F.col("buying_power"))),
        "strike": F.col("strike_price"), "rate": F.lit(p.risk_free), "vol": F.lit(p.vol),
        "stress": F.lit(p.stress),
    }).withColumn("years", F.col("days") / 365.0)
    priced = stress_payoff(rows, p.multiplier)
    priced = priced.withColumn("target_contracts", F.when(
        F.col("reason").isNull(), contracts_needed(priced, p)).otherwise(F.lit(0).cast("bigint")))
    more = F.col("target_contracts") - F.coalesce("matching_qty", F.lit(0.0))
    buy = F.when(F.col("target_contracts") > 0, F.greatest(more.cast("bigint"), F.lit(0)))
    return priced.select(
        "portfolio_id", "symbol", "strike", "days", "put_price", "payoff", "budget",
        "target_contracts", F.coalesce(buy, F.lit(0).cast("bigint")).alias("contracts_to_buy"), "reason",
    )
