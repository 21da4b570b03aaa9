"""Portfolio construction and trade plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import asof, hedging, lookup, orders, portfolio as pf
from tidemark.plans.common import landed_valuations
from tidemark.plans.registry import query
from tidemark.session import land

EQUITY = 100_000.0
POLL_SECONDS = 3 * 86_400.0     # the order events of the fixture are days apart


def weights(t):
    return pf.inverse_beta_weights(t.portfolio_picks)


@query()
def p1_inverse_beta_weights(t):
    return weights(t).select("portfolio_id", "ticker", "pick_rank", "weight")


@query()
def p2_capped_distribution(t):
    """Five cases of each portfolio, none of whose names may be lifted above 15 percent: half of it
    is spread again, some names are above the cap, some or all are without weight, and an amount
    is negative."""
    w, name = F.col("weight"), F.col("portfolio_id")
    odd = F.when(F.col("pick_rank") % 2 == 1, F.lit(0.0)).otherwise(w / 2)
    cases = [("half", w / 2, 0.5), ("high", w * 1.5, 0.2), ("gaps", odd, 0.6), ("empty", F.lit(0.0), 0.1),
             ("negative", w / 2, -0.1)]
    spread = weights(t).select("ticker", F.inline(F.array(*[F.struct(
        F.concat(name, F.lit(f" {case}")).alias("portfolio_id"), start.alias("weight"),
        F.lit(amount).alias("amount")) for case, start, amount in cases])))
    return pf.distribute_capped(spread, "amount", 0.15).select(
        "portfolio_id", "ticker", "weight", "new_weight"
    )


@query()
def p3_capped_weights(t):
    """The industries, and forty portfolios across them."""
    mixed = t.companies.select(
        F.format_string("mixed %s", F.col("universe_pos") % 40).alias("portfolio_id"), "ticker", "sector", "beta",
        F.col("universe_pos").cast("int").alias("pick_rank"))
    return pf.capped_weights(t.portfolio_picks.select(mixed.columns).unionByName(mixed))


@query()
def a10_sector_totals(t):
    return pf.sector_totals(weights(t))


@query()
def p4_liquidation_plan(t):
    v = landed_valuations(t).filter(F.col("as_of") == F.lit(fx.AS_OF[1]).cast("date"))
    return pf.liquidation_plan(t.positions, t.targets, v)


@query()
def p5_rebalance_plan(t):
    return pf.rebalance_plan(weights(t), t.positions, EQUITY).select(
        "portfolio_id", "ticker", "side", "target_notional", "current_notional", "order_notional",
        "status",
    )


@query()
def p6_cent_allocation(t):
    plan = pf.rebalance_plan(weights(t), t.positions, EQUITY)
    return pf.fit_to_buying_power(plan, 33_333.33).select(
        "portfolio_id", "ticker", "side", "order_notional", "scaled", "status"
    )


def post_fill(t):
    k = F.col("universe_pos")
    sectors = t.companies.select(F.col("ticker").alias("symbol"), "sector")
    excess = F.col("market_value") - 0.15 * EQUITY
    trims = t.positions.join(
        t.companies.select(F.col("ticker").alias("symbol"), "universe_pos"), "symbol"
    ).filter(k % 3 != 0).select(
        "symbol", F.when(k % 3 == 1, excess).otherwise(excess / 2).alias("trimmed")
    )
    return pf.post_fill_check(t.positions, sectors, trims, EQUITY)


@query()
def p7_post_fill_check(t):
    return post_fill(t)


@query()
def p7_caps_resolved(t):
    return pf.caps_resolved(post_fill(t))


@query()
def p8_fill_labels(t):
    o = orders.resolve_orders(t.order_events, interval_seconds=POLL_SECONDS)
    return o.select("order_id", orders.fill_label("liquidation").alias("liquidation"),
                    orders.fill_label("rebalance").alias("rebalance"))


@query()
def p9_holdings_weights(t):
    return pf.holdings_of(t.positions, EQUITY)


@query()
def j8_positions_against_targets(t):
    targets = t.targets.select(F.col("ticker").alias("symbol"))
    left = t.positions.join(targets, "symbol", "left_anti").select(
        "symbol", F.lit("left_targets").alias("kind"), "market_value"
    )
    held = t.positions.select("symbol", "market_value")
    kept = targets.join(held, "symbol", "left").select(
        "symbol", F.lit("target").alias("kind"),
        F.coalesce("market_value", F.lit(0.0)).alias("market_value"),
    )
    return left.unionByName(kept)


@query()
def j9_exits_not_rebought(t):
    done = orders.resolve_orders(t.order_events, interval_seconds=POLL_SECONDS).withColumn(
        "status", orders.fill_label("liquidation"))
    return pf.keep_after_exits(t.companies.select("ticker"), done)


def spot_quotes(t):
    spot = asof.as_of_price(t.macro_prices.filter("ticker = 'IDX'"), [fx.AS_OF[1]])
    name = F.replace("ticker", F.lit("IDX"), F.lit("SPY"))
    own = spot.select(name.alias("underlying"), "as_of", F.col("price").alias("spot"))
    # a second underlying, on which no contract is listed
    return land(own.unionByName(own.select(
        F.lit("IWM").alias("underlying"), "as_of", (F.col("spot") / 2).alias("spot"))), "spot-quotes")


@query()
def j10_nearest_contract(t):
    return hedging.nearest_contract(t.option_chain, spot_quotes(t))


@query()
def a11_hedge_exposure(t):
    chosen = hedging.nearest_contract(t.option_chain, spot_quotes(t))
    return hedging.hedge_exposure(t.hedge_positions, chosen)


@query()
def p10_hedge_plan(t):
    return hedging.hedge_plan(t.hedge_requests, t.option_chain, spot_quotes(t), t.hedge_positions)


@query()
def k3_allocation_view(t):
    return lookup.allocation(t.positions.select("symbol", "market_value"), EQUITY)
