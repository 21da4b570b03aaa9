"""Returns, covariance, simulated risk and option pricing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import hedging, risk
from tidemark.params import HedgeParams
from tidemark.plans.registry import query
from tidemark.session import land

DAY = fx.AS_OF[1]
H = HedgeParams()


def landed_returns(t):
    return land(risk.log_returns(t.risk_prices, DAY), "returns")


@query()
def w3_log_returns(t):
    return risk.log_returns(t.company_prices, DAY)


@query()
def v3_usable_history(t):
    """Names with at least two closes, and how many returns each has."""
    return risk.log_returns(t.prices, DAY).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("returns"), F.min("date").alias("first_date")
    )


@query()
def a7_return_stats(t):
    return risk.return_stats(risk.log_returns(t.company_prices, DAY))


@query()
def j4_complete_dates(t):
    return risk.complete_dates(landed_returns(t))


@query()
def j7_holdings_returns(t):
    return risk.held_returns(t.holdings, landed_returns(t))


@query()
def a8_covariance(t):
    return risk.covariance(landed_returns(t)).withColumn("covariance", F.col("covariance") * 1e4)


@query()
def a8_mean_vector(t):
    return risk.mean_vector(landed_returns(t)).withColumn("mean", F.col("mean") * 1e2)


@query()
def a8_sector_covariance(t):
    """The names of one sector alone, over the dates that these share."""
    names = t.companies.filter(F.col("sector") == t.companies.agg(F.min("sector")).scalar())
    return risk.covariance(landed_returns(t), names.select("ticker"), block_names=16, block_dates=64).withColumn(
        "covariance", F.col("covariance") * 1e4)


@query()
def a9_tail_risk(t):
    o = t.raw("orders").select(
        F.col("o_orderpriority").alias("portfolio_id"),
        ((F.col("o_totalprice") - 250000.0) / 1e6).alias("r"),
    )
    return risk.tail_risk(o, ("portfolio_id",), "r")


@query()
def v1_weight_policy(t):
    returns = landed_returns(t)
    policy = risk.weight_policy(t.holdings, returns, risk.held_returns(t.holdings, returns))
    return risk.rescaled_weights(t.holdings, policy, returns)


@query()
def v2_status_ladder(t):
    returns = landed_returns(t)
    return risk.weight_policy(t.holdings, returns, risk.held_returns(t.holdings, returns))


@query()
def v4_single_asset_simulation(t):
    """One-name portfolios only, by the same sampler."""
    one = t.holdings.filter("ticker = 'IDX'")
    return risk.portfolio_var(one, t.risk_prices, DAY)


@query()
def v5_simulated_paths(t):
    returns = landed_returns(t)
    held = risk.held_returns(t.holdings, returns)
    policy = risk.weight_policy(t.holdings, returns, held)
    w = risk.rescaled_weights(t.holdings, policy, returns)
    return risk.simulate_paths(w, held)


@query()
def v6_portfolio_var(t):
    return risk.portfolio_var(t.holdings, t.risk_prices, DAY)


def priced_chain(t):
    chain = t.option_chain.filter(F.col("expiration_date") > F.lit(DAY).cast("date"))
    return chain.select(
        "symbol", F.lit(98.5).alias("spot"), F.col("strike_price").alias("strike"),
        (F.datediff("expiration_date", F.lit(DAY).cast("date")) / 365.0).alias("years"),
        F.lit(H.risk_free).alias("rate"), F.lit(H.vol).alias("vol"),
        F.lit(H.stress).alias("stress"),
    )


@query()
def v7_put_pricing(t):
    return hedging.price_puts(priced_chain(t)).select("symbol", "d1", "d2", "put_price", "put_delta")


@query()
def v8_stress_payoff(t):
    return hedging.stress_payoff(priced_chain(t)).select("symbol", "stressed_put_price", "payoff")


@query()
def v9_contract_sizing(t):
    """Sizes over customers' exposures, including zero, negative and unaffordable ones."""
    c = F.col("c_custkey")
    rows = t.raw("customer").select(
        "c_custkey", F.col("c_acctbal").alias("var_dollars"), F.lit(580.0).alias("spot"),
        (540.0 + (c % 80)).alias("strike"), (c % 45).cast("int").alias("days"),
        F.when(c % 17 == 0, F.lit(float("nan"))).otherwise(F.lit(0.15)).alias("vol"),
        F.lit(0.04).alias("rate"), F.lit(0.07).alias("stress"),
        F.when(c % 4 != 0, 300.0 * (c % 20)).alias("budget"),
    ).withColumn("years", F.col("days") / 365.0)
    sized = hedging.stress_payoff(rows)
    return sized.select("c_custkey", hedging.contracts_needed(sized).alias("contracts"))
