"""Weights, caps and trade plans. Tables out; nothing is submitted anywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import ratio
from tidemark.params import PortfolioParams
from tidemark.session import land


def inverse_risk(beta="beta", p: PortfolioParams = PortfolioParams()) -> Column:
    return 1.0 / F.greatest(F.coalesce(F.col(beta), F.lit(p.default_beta)), F.lit(p.beta_floor))


def inverse_beta_weights(picks: DataFrame, p: PortfolioParams = PortfolioParams()) -> DataFrame:
    """Share of each pick before any cap."""
    raw = picks.withColumn("raw", inverse_risk(p=p))
    sums = raw.groupBy("portfolio_id").agg(F.sum("raw").alias("raw_sum"))
    return raw.join(sums, "portfolio_id").withColumn("weight", F.col("raw") / F.col("raw_sum")).drop("raw", "raw_sum")


def distribute_capped(weights: DataFrame, amount: str, cap: float,
                      p: PortfolioParams = PortfolioParams()) -> DataFrame:
    """Pour `amount` over the rows of a portfolio in proportion to their weights, none above
    the cap; what does not fit stays cash. No weight is lowered; amounts up to eps change nothing.

    Pouring in rounds keeps the rows below the cap proportional, so each of them ends at
    min(cap, level * weight) with one level per portfolio: the largest are full, and the level
    spreads the rest. Rows without weight share equally what the others cannot take. Null weights
    stay null. portfolio_id is not null.
    """
    weight = F.col("weight")
    is_open = (weight > 0) & (weight < cap)
    rows = land(weights, "pour")
    sums = land(rows.groupBy("portfolio_id").agg(
        F.max(amount).alias("amount_sum"),
        F.coalesce(F.sum(F.when(is_open, weight)), F.lit(0.0)).alias("open_sum"),
        F.coalesce(F.sum(F.when(is_open, cap - weight)), F.lit(0.0)).alias("room"),
        F.count_if(weight == 0).alias("empties"),
    ).withColumn("target", F.col("open_sum") + F.col("amount_sum")), "pour-sums")
    levels = _levels(rows.filter(is_open).select("portfolio_id", "weight"),
                     sums.select("portfolio_id", "target"), cap)
    facts = sums.select("portfolio_id", "amount_sum", "room", "empties").join(levels, "portfolio_id", "left")
    rows = rows.join(facts, "portfolio_id")
    poured = F.greatest(weight, F.least(F.lit(cap), F.coalesce(F.col("level") * weight, F.lit(cap))))
    spare = F.greatest(F.lit(0.0), F.col("amount_sum") - F.col("room"))
    shared = F.least(F.lit(cap), spare / F.col("empties"))
    changed = F.when(is_open, poured).when(weight == 0, shared).otherwise(weight)
    return rows.withColumn(
        "new_weight", F.when(F.col(amount) > p.eps, changed).otherwise(weight)
    ).drop("amount_sum", "room", "empties", "level")


def _levels(opens: DataFrame, targets: DataFrame, cap: float, per_octave: int = 1024) -> DataFrame:
    """portfolio_id and level: with the rows above it full, the first weight in descending order that
    the level (target - cap * full) / (sum of the others) does not lift above the cap. Portfolios
    that fill up whole have none.

    Whether a weight fits holds for all smaller ones too, so sums of narrow ranges of weights, per
    portfolio a few thousand, tell in which range the first one is; only the distinct weights of
    that range are ordered.
    """
    span = F.floor(F.log2("weight") * per_octave).alias("span")
    down = Window.partitionBy("portfolio_id").orderBy(F.desc("span"))
    above, below = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(1, Window.unboundedFollowing)
    spans = opens.groupBy("portfolio_id", span).agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"), F.max("weight").alias("largest"))
    spans = spans.withColumns({
        "ahead": F.coalesce(F.sum("n").over(above), F.lit(0)),
        "behind": F.coalesce(F.sum("total").over(below), F.lit(0.0)),
    }).join(targets, "portfolio_id")
    level = ratio(F.col("target") - F.col("ahead") * cap, F.col("total") + F.col("behind"))
    fits = level * F.col("largest") <= cap
    edge = land(spans.withColumns({"level": level, "fits": fits}).groupBy("portfolio_id").agg(
        F.max(F.when(F.col("fits"), F.struct("span", "level"))).alias("start"),
        F.min(F.when(~F.col("fits"), F.struct("span", "ahead", "behind"))).alias("inside"),
        F.max("target").alias("target"),
    ), "pour-edges")
    within = Window.partitionBy("portfolio_id").orderBy(F.desc("weight"))
    before, rest = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(0, Window.unboundedFollowing)
    inside = edge.filter("inside is not null").select("portfolio_id", "target", "inside.*")
    values = opens.select("*", span).join(inside, ["portfolio_id", "span"]).groupBy(
        "portfolio_id", "weight", "target", "ahead", "behind").agg(F.count(F.lit(1)).alias("n"))
    full = F.col("ahead") + F.coalesce(F.sum("n").over(before), F.lit(0))
    tail = F.col("behind") + F.sum(F.col("n") * F.col("weight")).over(rest)
    values = values.withColumn("level", ratio(F.col("target") - full * cap, tail))
    found = values.filter(F.col("level") * F.col("weight") <= cap).groupBy("portfolio_id").agg(
        F.max_by("level", "weight").alias("found"))
    return edge.join(found, "portfolio_id", "left").select(
        "portfolio_id", F.coalesce("found", "start.level").alias("level"))


def _poured(rows: DataFrame, cap: float) -> DataFrame:
    """rows (portfolio_id, base, into, extra) with weight: base, and in the rows marked into the
    portfolio's sum of extra, poured in proportion and none lifted above the cap; amount is that sum.

    Rows end at min(cap, level * base) as in distribute_capped. Weights of a portfolio sum to one at
    most, so no more than 1 / cap rows can be full: the level follows from the sum of the open rows and
    the few largest, and no portfolio is sorted or gathered.
    """
    few = math.ceil(1 / cap) + 1
    sums = rows.groupBy("portfolio_id").agg(
        F.sum(F.when(F.col("into"), F.col("base"))).alias("open"), F.sum("extra").alias("amount"))
    largest = Window.partitionBy("portfolio_id").orderBy(F.desc("base"))
    top = rows.where("into").select("portfolio_id", "base", F.row_number().over(largest).alias("n")).where(
        F.col("n") <= few).groupBy("portfolio_id").agg(F.sort_array(F.collect_list("base"), False).alias("top"))

    def level(full):
        taken = F.aggregate(F.slice("top", 1, full), F.lit(0.0), lambda x, y: x + y)
        return ratio(F.col("open") + F.col("amount") - cap * full, F.col("open") - taken)

    tries = F.transform(F.sequence(F.lit(0), F.size("top") - 1), lambda k: F.struct(
        level(k).alias("level"), F.get("top", k).alias("next")))
    fits = F.get(F.filter(tries, lambda x: x["level"] * x["next"] <= cap), 0)["level"]
    levels = sums.join(top, "portfolio_id", "left").select(
        "portfolio_id", "amount", F.when(F.col("top").isNotNull(), fits).alias("level"))
    lifted = F.greatest("base", F.least(F.lit(cap), F.coalesce(F.col("level") * F.col("base"), F.lit(cap))))
    return rows.join(levels, "portfolio_id").withColumn(
        "weight", F.when(F.col("into") & (F.col("amount") > 0), lifted).otherwise(F.col("base")))


def capped_weights(picks: DataFrame, p: PortfolioParams = PortfolioParams()) -> DataFrame:
    """Joint position and sector caps: portfolio_id, ticker, sector, pick_rank and weight.

    Rounds of two steps: what positions have above their cap goes to the others, then what sectors have
    above theirs goes to the names of sectors below it, by the totals the round began with. Names
    without sector are one sector. A portfolio leaves when a round changes nothing, after p.rounds at
    the latest. Steps are aggregates over all portfolios at once; the driver sees whether any is left.
    """
    name = F.coalesce("sector", F.lit("Unknown"))
    state = inverse_beta_weights(picks, p).select("portfolio_id", "ticker", "sector", "pick_rank", "weight")
    state, done = land(state, "weights"), None
    for _ in range(p.rounds):
        tall = F.col("weight") > p.position_cap + p.eps
        rows = state.select(
            *state.columns[:4], F.when(tall, p.position_cap).otherwise(F.col("weight")).alias("base"), (~tall).alias("into"),
            F.when(tall, F.col("weight") - p.position_cap).otherwise(0.0).alias("extra"))
        rows = land(_poured(rows, p.position_cap).select(
            *state.columns, (F.col("amount") > 0).alias("moved"), name.alias("name")), "position-caps")
        totals = rows.groupBy("portfolio_id", "name").agg(F.sum("weight").alias("total"))
        heavy, share = F.col("total") > p.sector_cap + p.eps, ratio(F.lit(p.sector_cap), "total")
        rows = rows.join(totals, ["portfolio_id", "name"]).select(
            *state.columns[:4], "moved", F.when(heavy, F.col("weight") * share).otherwise(F.col("weight")).alias("base"),
            (F.col("total") < p.sector_cap - p.eps).alias("into"),
            F.when(heavy, F.col("weight") * (1 - share)).otherwise(0.0).alias("extra"))
        rows = land(_poured(land(rows, "sector-totals"), p.position_cap).select(
            *state.columns, (F.col("moved") | (F.col("amount") > 0)).alias("moved")), "sector-caps")
        settled = rows.where("not moved").select(state.columns)
        done = settled if done is None else done.unionByName(settled)
        state = rows.where("moved").select(state.columns)
        if state.isEmpty():
            return done
    return state if done is None else done.unionByName(state)


def sector_totals(weights: DataFrame, keys=("portfolio_id",),
                  p: PortfolioParams = PortfolioParams()) -> DataFrame:
    sector = F.coalesce(F.nullif("sector", F.lit("")), F.lit("Unknown"))
    return weights.groupBy(*keys, sector.alias("sector")).agg(
        F.sum("weight").alias("sector_weight")
    ).withColumn("breach", F.col("sector_weight") > p.sector_cap + p.eps)


def liquidation_plan(positions: DataFrame, targets: DataFrame, values: DataFrame) -> DataFrame:
    """Equities that left the targets or reached their intrinsic value. Options stay."""
    held = positions.filter(F.col("asset_class") == "us_equity")
    j = held.join(targets.select(F.col("ticker").alias("symbol"), F.lit(True).alias("wanted")),
                  "symbol", "left")
    j = j.join(values.select(F.col("ticker").alias("symbol"), "intrinsic_value"), "symbol", "left")
    reason = F.when(F.col("wanted").isNull(), "left_targets").when(
        F.col("current_price") >= F.col("intrinsic_value"), "profit_taking"
    )
    return j.withColumn("reason", reason).filter("reason is not null").select(
        "symbol", "qty", "market_value", "reason"
    )


def rebalance_plan(targets: DataFrame, positions: DataFrame, equity: float,
                   p: PortfolioParams = PortfolioParams()) -> DataFrame:
    """Order size and status per target before buying power is considered."""
    now = positions.select(F.col("symbol").alias("ticker"),
                           F.col("market_value").alias("held_value"))
    j = targets.join(now, "ticker", "left").withColumn(
        "current_notional", F.coalesce("held_value", F.lit(0.0))
    ).withColumn("target_notional", equity * F.col("weight"))
    current_weight = F.col("current_notional") / equity if equity else F.lit(0.0)
    drift = F.abs(current_weight - F.col("weight"))
    order = F.col("target_notional") - F.col("current_notional")
    status = F.when(drift <= p.drift, "within_drift").when(
        F.abs(order) < p.min_order, "below_minimum"
    ).otherwise("pending")
    sized = F.when(
        (status == "pending") & (order < 0) & (-order > F.col("current_notional")),
        -F.col("current_notional"),
    ).otherwise(order)
    return j.drop("held_value").withColumns({
        "side": F.when(order >= 0, "buy").otherwise("sell"), "order_notional": sized,
        "status": status,
    })


def cents(c: Column) -> Column:
    """Whole cents, rounded down from the decimal value of a non-negative amount."""
    exact = F.greatest(c, F.lit(0.0)).cast("decimal(30,12)")
    return F.floor(exact * 100).cast("bigint")


RANKS = 4096


def running_sum(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Sum of value over the rows of a portfolio up to each one, by pick_rank and ticker, those
    without rank first. Ranks are cut into blocks of RANKS: the sums of the blocks are summed up
    first, then the rows of a block among themselves, so no task orders a whole portfolio."""
    block = F.coalesce(F.floor(F.col("pick_rank") / RANKS), F.lit(-1))
    earlier = Window.partitionBy("portfolio_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("portfolio_id", "block").orderBy("pick_rank", "ticker").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("block", block)
    starts = rows.groupBy("portfolio_id", "block").agg(F.sum(value).alias("block_sum")).select(
        "portfolio_id", "block", F.coalesce(F.sum("block_sum").over(earlier), F.lit(0)).alias("block_start"))
    return rows.join(starts, ["portfolio_id", "block"]).withColumn(
        name, F.col("block_start") + F.sum(value).over(upto)).drop("block", "block_start")


def fit_to_buying_power(plan: DataFrame, buying_power: float | None,
                        p: PortfolioParams = PortfolioParams()) -> DataFrame:
    """Scale pending buys to the budget, then hand out whole cents in pick order. Without a
    budget every pending order keeps its size.

    Giving each order min(own cents, cents left) equals the increase of min(running sum,
    budget), so no sequential loop is needed and the budget can never be exceeded.
    """
    buying = (F.col("status") == "pending") & (F.col("side") == "buy")
    if buying_power is None:
        done = F.when(F.col("status") != "pending", F.col("status")).when(buying, "would_buy")
        return plan.withColumns({"scaled": F.lit(False), "status": done.otherwise("would_sell")})
    total = F.sum(F.when(buying, F.col("order_notional")).otherwise(F.lit(0.0)))
    rows = plan.join(plan.groupBy("portfolio_id").agg(total.alias("total_buys")), "portfolio_id")
    scaled = buying & (F.col("total_buys") > 0) & (F.col("total_buys") > buying_power + p.eps)
    rows = rows.withColumn("scaled", scaled).withColumn(
        "ideal", F.when(scaled, F.col("order_notional") * ratio(F.lit(max(buying_power, 0.0)),
                                                                "total_buys"))
        .otherwise(F.col("order_notional")),
    )
    own = F.when(buying, cents(F.col("ideal"))).otherwise(F.lit(0).cast("bigint"))
    rows = running_sum(rows.withColumn("own_cents", own), "own_cents", "sum_cents")
    budget = cents(F.lit(float(buying_power)))
    given = F.least(F.col("sum_cents"), budget) - F.least(
        F.col("sum_cents") - F.col("own_cents"), budget
    )
    rows = rows.withColumn(
        "order_notional", F.when(buying, given / F.lit(100.0)).otherwise(F.col("ideal"))
    )
    status = (
        F.when(F.col("status") != "pending", F.col("status"))
        .when(F.col("scaled") & (F.abs("order_notional") < p.min_order), "unaffordable")
        .when((F.col("side") == "buy") & F.col("scaled"), "would_buy_scaled")
        .when(F.col("side") == "buy", "would_buy").otherwise("would_sell")
    )
    return rows.withColumn("status", status).drop("total_buys", "ideal", "own_cents", "sum_cents")


def post_fill_check(positions: DataFrame, sectors: DataFrame, trims: DataFrame, equity: float,
                    p: PortfolioParams = PortfolioParams()) -> DataFrame:
    """Weight of each equity after confirmed trims, and whether its cap is resolved."""
    held = positions.filter(F.col("asset_class") == "us_equity")
    j = held.join(trims, "symbol", "left").join(sectors, "symbol", "left")
    cap_value = p.position_cap * equity
    over = F.col("market_value") / equity > p.position_cap + p.eps
    # greatest skips nulls, so an unconfirmed trim must be kept apart
    remaining = F.when(
        F.col("trimmed").isNotNull(),
        F.greatest(F.col("market_value") - F.col("trimmed"), F.lit(0.0)),
    )
    settled = remaining <= cap_value + p.trim_tolerance
    weight = (
        F.when(~over | F.col("trimmed").isNull(), F.col("market_value") / equity)
        .when(settled, F.least(remaining / equity, F.lit(p.position_cap)))
        .otherwise(remaining / equity)
    )
    return j.select(
        "symbol", F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        F.when(over, F.col("market_value") - cap_value).otherwise(F.lit(0.0)).alias("excess"),
        weight.alias("weight"),
        (~over | F.coalesce(settled, F.lit(False))).alias("resolved"),
    )


def caps_resolved(checked: DataFrame, p: PortfolioParams = PortfolioParams()) -> DataFrame:
    """One row: all positions resolved and no sector above its cap."""
    breach = sector_totals(checked, (), p).agg(F.bool_or("breach"))
    rows = checked.agg(F.bool_and("resolved").alias("positions_ok"))
    return rows.withColumn("sector_breach", breach.scalar()).withColumn(
        "resolved", F.col("positions_ok") & ~F.col("sector_breach")
    )


def holdings_of(positions: DataFrame, equity: float) -> DataFrame:
    return positions.filter(F.col("asset_class") == "us_equity").select(
        F.col("symbol").alias("ticker"), (F.col("market_value") / equity).alias("weight")
    )


def keep_after_exits(picks: DataFrame, exits: DataFrame) -> DataFrame:
    """Names just sold are not bought back in the same run."""
    gone = exits.filter(F.startswith("status", F.lit("LIQUIDATED"))).select(
        F.col("symbol").alias("ticker")
    )
    return picks.join(gone, "ticker", "left_anti")
