"""Weights, caps, cents, hedges, quantiles and simulated risk."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark import schemas
from tidemark.functions.normal import normal_cdf
from tidemark.operators import hedging, portfolio as pf, quantiles, risk, screens
from tidemark.params import HedgeParams, PortfolioParams, RiskParams

P = PortfolioParams()


def brute_pour(weights, names, amount, cap):
    """Round-by-round pouring, the definition the closed form must equal."""
    names = list(names)
    while amount > 1e-12 and names:
        pool = sum(weights[n] for n in names)
        share = {n: amount * weights[n] / pool if pool > 0 else amount / len(names) for n in names}
        full = [n for n in names if weights[n] + share[n] > cap]
        amount = 0.0
        for n in names:
            give = min(share[n], max(cap - weights[n], 0.0))
            amount += share[n] - give
            weights[n] += give
        names = [n for n in names if n not in full]
        if not full:
            break


def brute_caps(picks):
    """Weights by rank: position caps, then sectors one by one, by the totals a round began with."""
    raw = {i: 1 / max(1.0 if beta is None else beta, 0.5) for _, _, _, beta, i in picks}
    sector = {i: s or "Unknown" for _, _, s, _, i in picks}
    w = {i: x / sum(raw.values()) for i, x in raw.items()}
    for _ in range(P.rounds):
        tall = [i for i in w if w[i] > P.position_cap + P.eps]
        spare = sum(w[i] - P.position_cap for i in tall)
        w |= dict.fromkeys(tall, P.position_cap)
        brute_pour(w, [i for i in w if i not in tall], spare, P.position_cap)
        totals = {s: sum(w[i] for i in w if sector[i] == s) for s in dict.fromkeys(sector.values())}
        heavy = [s for s in totals if totals[s] > P.sector_cap + P.eps]
        below = [i for i in w if totals[sector[i]] < P.sector_cap - P.eps]
        for s in heavy:
            for i in w:
                if sector[i] == s:
                    w[i] *= P.sector_cap / totals[s]
            brute_pour(w, below, totals[s] - P.sector_cap, P.position_cap)
        if not tall and not heavy:
            break
    return w


def test_joint_caps_equal_round_by_round(spark):
    rng = random.Random(5)
    picks = [(f"P{p}", f"T{i}", rng.choice(["A", "B", "C", "D", "E", None]),
              rng.choice([None, rng.uniform(-1, 3)]), i)
             for p in range(40) for i in range(rng.randint(1, 12 if p % 2 else 60))]
    picks += [("one", "T", "A", 1.0, 1)] + [("same", f"T{i}", "A", 2.0, i) for i in range(9)]
    df = spark.createDataFrame(
        picks, "portfolio_id string, ticker string, sector string, beta double, pick_rank int")
    out = pf.capped_weights(df).collect()
    assert len(out) == len(picks)
    moved = 0
    for p in {r.portfolio_id for r in out}:
        want = brute_caps([x for x in picks if x[0] == p])
        own = {r.pick_rank: r.weight for r in out if r.portfolio_id == p}
        assert all(math.isclose(own[i], want[i], abs_tol=1e-8) for i in want) and len(own) == len(want)
        assert sum(own.values()) <= 1 + 1e-9 and max(own.values()) <= P.position_cap + 1e-6
        moved += sum(want.values()) < 1 - 1e-6
    assert moved > 5
    assert pf.capped_weights(df.limit(0)).count() == 0


def plan_frame(spark, orders):
    return spark.createDataFrame(
        [("P", f"T{i}", i, side, x, "pending") for i, (side, x) in enumerate(orders)],
        "portfolio_id string, ticker string, pick_rank int, side string, order_notional double, "
        "status string")


def test_cents_never_exceed_the_budget(spark):
    rng = random.Random(11)
    batches = []
    for b in range(120):
        for i in range(rng.randint(3, 8)):
            batches.append((f"B{b}", f"T{i}", i, "buy", rng.uniform(10, 1000), "pending"))
    df = spark.createDataFrame(
        batches, "portfolio_id string, ticker string, pick_rank int, side string, "
        "order_notional double, status string")
    out = pf.fit_to_buying_power(df, 100.0)
    cents = out.groupBy("portfolio_id").agg(
        F.sum(F.round(F.col("order_notional") * 100).cast("bigint")).alias("c")).collect()
    assert all(r.c <= 10_000 for r in cents) and max(r.c for r in cents) > 9_900


def test_cents_round_down_and_sells_are_untouched(spark):
    df = plan_frame(spark, [("buy", 10.019), ("sell", -55.555), ("buy", 0.3)])
    out = rows(pf.fit_to_buying_power(df, 1_000.0), "ticker")
    assert out["T0"].order_notional == 10.01 and out["T0"].status == "would_buy"
    assert out["T1"].order_notional == -55.555 and out["T1"].status == "would_sell"
    tight = rows(pf.fit_to_buying_power(df, 0.5), "ticker")
    assert tight["T0"].status == "unaffordable" and tight["T0"].order_notional < 0.5
    assert tight["T1"].order_notional == -55.555
    free = rows(pf.fit_to_buying_power(df, None), "ticker")
    assert free["T0"].order_notional == 10.019


@pytest.mark.parametrize("market, trimmed, ok", [
    (15_000.0, None, True), (16_000.0, None, False), (16_000.0, 1_000.0, True),
    (16_000.0, 999.99, True), (16_000.0, 999.0, False), (16_000.0, 10.0, False),
])
def test_trim_tolerance_is_one_cent(spark, market, trimmed, ok):
    pos = spark.createDataFrame([("A", "us_equity", 1.0, market, 1.0, 1.0)], schemas.POSITIONS)
    trims = spark.createDataFrame([("A", trimmed)], "symbol string, trimmed double")
    sec = spark.createDataFrame([("A", "S")], "symbol string, sector string")
    assert pf.post_fill_check(pos, sec, trims, 100_000.0).first().resolved is ok


def test_normal_distribution_against_erf(spark):
    xs = [i / 50 for i in range(-2000, 2001)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", normal_cdf("x").alias("n")).collect():
        want = 0.5 * math.erfc(-r.x / math.sqrt(2))
        assert math.isclose(r.n, want, rel_tol=1e-9, abs_tol=2e-15), r.x


def hedge(spark, **over):
    base = dict(var_dollars=10_000.0, spot=580.0, strike=580.0, days=30.0, vol=0.15, rate=0.04,
                stress=0.07, budget=None)
    base.update(over)
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} double" for k in base))
    df = hedging.stress_payoff(df.withColumn("years", F.col("days") / 365.0))
    return df.select(hedging.contracts_needed(df, HedgeParams(max_contracts=10_000)).alias("n")).first().n


def test_hedge_size_matches_hand_payoff(spark):
    def put(s):
        t, v, r, k = 30 / 365, 0.15, 0.04, 580.0
        d1 = (math.log(s / k) + (r + v * v / 2) * t) / (v * math.sqrt(t))
        n = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
        return k * math.exp(-r * t) * n(-(d1 - v * math.sqrt(t))) - s * n(-d1)

    payoff = (put(580 * 0.93) - put(580)) * 100
    assert hedge(spark) == math.ceil(10_000 / payoff)
    assert hedge(spark, budget=put(580) * 100 * 2.5) == 2
    assert hedge(spark, budget=0.0) == 0


@pytest.mark.parametrize("over", [
    dict(var_dollars=0.0), dict(var_dollars=float("nan")), dict(spot=0.0), dict(strike=None),
    dict(days=0.0), dict(days=1.5), dict(vol=0.0), dict(vol=10.5), dict(rate=-6.0),
    dict(stress=0.0), dict(stress=1.0), dict(budget=float("inf")), dict(spot=1e308, strike=1e-308),
])
def test_invalid_hedge_inputs_size_to_zero(spark, over):
    assert hedge(spark, **over) == 0


def test_wilder_index_matches_the_recursion(spark):
    rng = random.Random(2)
    start = date(2024, 1, 1)
    closes = {"A": [100 + rng.gauss(0, 3) for _ in range(60)], "UP": list(range(1, 30)),
              "SHORT": [1.0] * 14, "EDGE": [10 + rng.random() for _ in range(15)]}
    df = spark.createDataFrame(
        [(t, start + timedelta(days=i), float(c)) for t, cs in closes.items()
         for i, c in enumerate(cs)], schemas.PRICES)
    got = rows(screens.wilder_rsi(df, "2024-12-31", since=F.lit("2024-01-01").cast("date")), "ticker")
    assert "SHORT" not in got and got["UP"].rsi == 100.0
    for t in ("A", "EDGE"):
        m = np.diff(closes[t])
        g, l = np.clip(m, 0, None), np.clip(-m, 0, None)
        ag, al = g[:14].mean(), l[:14].mean()
        for x, y in zip(g[14:], l[14:]):
            ag, al = (ag * 13 + x) / 14, (al * 13 + y) / 14
        assert math.isclose(got[t].rsi, 100 - 100 / (1 + ag / al), rel_tol=1e-12)


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_grouped_quantile_is_exact_under_skew_and_ties(spark, q):
    rng = np.random.default_rng(1)
    data = {"big": rng.normal(size=90_000), "ties": np.repeat([1.0, 2.0, 3.0], [5, 40_000, 4]),
            "one": np.array([7.0]), "pair": np.array([1.0, 4.0])}
    import pandas as pd

    frame = pd.concat([pd.DataFrame({"g": k, "v": vs}) for k, vs in data.items()])
    df = spark.createDataFrame(frame, "g string, v double").repartition(8).union(
        spark.createDataFrame([("one", None)], "g string, v double"))
    got = rows(quantiles.grouped_quantile(df, ["g"], "v", q, "x"), "g")
    for k, vs in data.items():
        assert math.isclose(got[k].x, np.quantile(vs, q), rel_tol=1e-12), k
        assert got[k].sample_count == len(vs)


def series(spark, days=300, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(0.0005, 0.01, size=(days, 3))
    base[:, 1] = 0.7 * base[:, 0] + 0.3 * base[:, 1]
    closes = 100 * np.exp(np.cumsum(base, axis=0))
    start = date(2023, 1, 1)
    cells = [(n, start + timedelta(days=i), float(closes[i, j]))
             for j, n in enumerate("ABC") for i in range(days)]
    return spark.createDataFrame(cells, schemas.PRICES), base


def test_covariance_blocks_do_not_change_the_matrix(spark):
    prices, _ = series(spark)
    r = risk.complete_dates(risk.log_returns(prices))
    one = rows(risk.covariance(r), "ticker_1", "ticker_2")
    many = rows(risk.covariance(r, block_names=1, block_dates=20), "ticker_1", "ticker_2")
    assert set(one) == set(many) and len(one) == 6
    wide = r.groupBy("date").pivot("ticker").agg(F.first("r")).toPandas()[["A", "B", "C"]].cov()
    for (a, b), v in many.items():
        assert math.isclose(v.covariance, wide.loc[a, b], rel_tol=1e-9)
        assert math.isclose(v.covariance, one[(a, b)].covariance, rel_tol=1e-9)


def test_covariance_of_some_names_uses_the_dates_that_these_share(spark):
    day = [date(2023, 1, d) for d in range(1, 6)]
    cells = [(n, d, v * k) for n, k in (("A", 1.0), ("B", -2.0)) for d, v in zip(day, (1.0, 2.0, 4.0, 8.0, 16.0))]
    r = spark.createDataFrame(cells + [("C", day[0], 1.0)], "ticker string, date date, r double")
    some = spark.createDataFrame([("A",), ("B",), ("unknown",)], "ticker string")
    got = rows(risk.covariance(r, some, block_names=1, block_dates=2), "ticker_1", "ticker_2")
    assert got.keys() == {("A", "A"), ("A", "B"), ("B", "B")}
    assert math.isclose(got["A", "A"].covariance, 37.2) and math.isclose(got["A", "B"].covariance, -74.4)
    alone = risk.covariance(r, block_names=2).collect()
    assert len(alone) == 6 and all(row.covariance is None for row in alone)
    assert rows(risk.mean_vector(r), "ticker")["B"].mean == -2.0
    assert risk.covariance(r.limit(0)).collect() == []


def test_simulated_var_matches_the_direct_sampler(spark):
    prices, _ = series(spark)
    h = spark.createDataFrame([("P", "A", 0.5), ("P", "B", 0.3), ("P", "C", 0.2)], schemas.HOLDINGS)
    p = RiskParams(simulations=20_000)
    got = risk.portfolio_var(h, prices, None, p).first()
    again = risk.portfolio_var(h, prices, None, p).first()
    r = risk.log_returns(prices).groupBy("date").pivot("ticker").agg(F.first("r")).toPandas()[
        ["A", "B", "C"]]
    rng = np.random.default_rng(0)
    draws = rng.multivariate_normal(r.mean(), r.cov(), size=(20_000, 21)).sum(axis=1)
    direct = np.expm1(draws) @ np.array([0.5, 0.3, 0.2])
    var = np.percentile(direct, 5)
    assert got.status == "ok" and got.cvar_95 <= got.var_95
    assert math.isclose(got.var_95, var, rel_tol=0.08)
    assert math.isclose(got.cvar_95, direct[direct <= var].mean(), rel_tol=0.08)
    assert math.isclose(got.var_95, again.var_95, rel_tol=1e-9)
    sliced = risk.portfolio_var(h, prices, None, RiskParams(simulations=20_000, slice=1)).first()
    assert math.isclose(got.var_95, sliced.var_95, rel_tol=1e-9)


def test_draws_are_normal_and_numbered():
    z = risk.draws(7, 0, 4000, 250)
    assert np.array_equal(z[1000:1500, :100], risk.draws(7, 1000, 500, 100))
    assert not np.allclose(z[:10], risk.draws(8, 0, 10, 250))
    assert abs(z.mean()) < 0.004 and abs(z.std() - 1) < 0.004
    assert abs(np.quantile(z, 0.05) + 1.6449) < 0.01 and abs((z ** 4).mean() - 3) < 0.05
    for lag in (1, 2, 7):       # neither days nor paths follow each other
        assert abs((z[:, lag:] * z[:, :-lag]).mean()) < 0.005 and abs((z[lag:] * z[:-lag]).mean()) < 0.005


def test_weight_policy_and_status(spark):
    prices, _ = series(spark, 30)
    flat = spark.createDataFrame(
        [("F", date(2023, 1, 1) + timedelta(days=i), 5.0) for i in range(30)], schemas.PRICES)
    lone = spark.createDataFrame([("L", date(2023, 1, 1), 5.0)], schemas.PRICES)
    prices = prices.union(flat).union(lone)
    cells = [("half", "A", 0.4), ("half", "NONE", 0.4), ("thin", "A", 0.39), ("thin", "NONE", 0.41),
             ("gone", "NONE", 1.0), ("lone", "L", 1.0), ("flat", "F", 1.0), ("zero", "A", 0.0),
             ("neg", "A", -0.1), ("cash", "A", 0.3), ("nan", "A", float("nan"))]
    h = spark.createDataFrame(cells, schemas.HOLDINGS)
    got = rows(risk.portfolio_var(h, prices, None, RiskParams(simulations=500)), "portfolio_id")
    assert got["half"].status == "ok"  # exactly half is enough
    assert got["thin"].message == "low_coverage"
    assert got["gone"].message == "no_history" and got["lone"].message == "no_history"
    assert (got["flat"].status, got["flat"].message) == ("insufficient_data", "zero_variance")
    assert got["zero"].message == "no_priced_weight"
    assert got["neg"].status == "error" and got["nan"].status == "error"
    assert got["cash"].status == "ok"
    returns = risk.log_returns(prices)
    held = risk.held_returns(h, returns)
    policy = risk.weight_policy(h, returns, held)
    w = rows(risk.rescaled_weights(h, policy, returns), "portfolio_id")
    assert math.isclose(w["half"].weight, 0.8)   # rescaled to the requested total
    assert math.isclose(w["cash"].weight, 0.3)   # cash stays cash


def test_tail_risk_flags_non_finite_paths(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 1.0), ("b", float("inf"))],
                               "g string, r double")
    got = rows(risk.tail_risk(df, ["g"], "r"), "g")
    assert math.isclose(got["a"].var_95, 4.95) and got["a"].cvar_95 == 2.0
    assert got["b"].status == "error" and got["b"].var_95 is None


def test_capped_pour_lowers_no_weight(spark):
    cases = {
        "zero": ([0.0, 0.0], 0.10, [0.05, 0.05]), "over": ([0.50, 0.05], 0.05, [0.50, 0.10]),
        "negative": ([0.10, 0.05], -0.1, [0.10, 0.05]), "tiny": ([0.1, 0.0], 1e-12, [0.1, 0.0]),
        "rest": ([0.14, 0.0, 0.0], 0.05, [0.15, 0.02, 0.02]), "only_full": ([0.2], 0.3, [0.2]),
        "too_much": ([0.1, 0.0], 1.0, [0.15, 0.15]),
    }
    rng = random.Random(5)
    for i in range(40):
        w = [rng.choice([0.0, rng.uniform(0, 0.2)]) for _ in range(rng.randint(1, 9))]
        want = dict(enumerate(w))
        amount = rng.uniform(0, 1)
        brute_pour(want, list(want), amount, 0.15)
        cases[f"r{i}"] = (w, amount, list(want.values()))
    df = spark.createDataFrame(
        [(p, f"T{i}", x, amount) for p, (w, amount, _) in cases.items() for i, x in enumerate(w)],
        "portfolio_id string, ticker string, weight double, amount double")
    got = rows(pf.distribute_capped(df, "amount", 0.15), "portfolio_id", "ticker")
    for p, (w, _, want) in cases.items():
        assert np.allclose([got[p, f"T{i}"].new_weight for i in range(len(w))], want, atol=1e-8), p


def test_pour_level_of_large_portfolios_with_ties(spark):
    rng = np.random.default_rng(3)
    w = {"ties": np.repeat([0.002, 0.0015, 0.0001], 2000), "close": 0.001 + rng.random(6000) * 1e-9,
         "wide": rng.pareto(1.2, 6000) * 1e-4, "whole": np.full(6000, 0.001)}
    amount = {"ties": 2.1, "close": 9.0, "wide": 3.0, "whole": 50.0}
    cap = 0.0025
    df = spark.createDataFrame([(p, f"T{i:05d}", float(x), amount[p]) for p, v in w.items() for i, x in enumerate(v)],
                               "portfolio_id string, ticker string, weight double, amount double")
    got = pf.distribute_capped(df, "amount", cap).orderBy("portfolio_id", "ticker").toPandas()
    for p, v in w.items():
        out = got[got.portfolio_id == p].new_weight.to_numpy()
        low, high = 1.0, 1e9
        for _ in range(200):
            level = (low + high) / 2
            poured = np.maximum(v, np.minimum(cap, level * v)).sum() - v.sum()
            low, high = (level, high) if poured < amount[p] else (low, level)
        assert np.allclose(out, np.maximum(v, np.minimum(cap, low * v)), rtol=1e-9, atol=0), p


def test_running_sum_over_blocks_of_ranks(spark):
    rng = random.Random(2)
    data = [(p, f"T{i % 7}", None if i % 1000 == 5 else rng.randint(0, 9000), rng.randint(0, 99))
            for p in ("a", "b") for i in range(6000)]
    df = spark.createDataFrame(data, "portfolio_id string, ticker string, pick_rank int, own bigint")
    got = pf.running_sum(df, "own", "sum").select("portfolio_id", "sum", "own").collect()
    for p in ("a", "b"):
        part = sorted((r["sum"], r.own) for r in got if r.portfolio_id == p)
        assert len(part) == 6000 and part[-1][0] == sum(r[3] for r in data if r[0] == p)
    last = df.groupBy("portfolio_id", "pick_rank").agg(F.sum("own").alias("own")).toPandas()
    tops = rows(pf.running_sum(df, "own", "sum").groupBy("portfolio_id", "pick_rank").agg(
        F.max("sum").alias("top")), "portfolio_id", "pick_rank")
    part = last[last.portfolio_id == "a"].sort_values("pick_rank", na_position="first")
    for rank, want in zip(part.pick_rank, part.own.cumsum()):
        assert tops["a", None if rank != rank else int(rank)].top == want


def test_hedge_plan_answers_every_request(spark):
    requests = spark.createDataFrame(
        [("a", "SPY", 1e6, 1e4, None), ("b", "NONE", 1e6, 1e4, None), ("c", "IWM", 1e6, 1e4, 5.0)],
        "portfolio_id string, underlying string, equity double, var_dollars double, buying_power double")
    day = date(2001, 6, 30)
    quotes = spark.createDataFrame([("SPY", day, 100.0), ("IWM", day, 50.0)],
                                   "underlying string, as_of date, spot double")
    chain = spark.createDataFrame(
        [("SPY1", "SPY", day + timedelta(days=30), 100.0, True, 1)],
        "symbol string, underlying string, expiration_date date, strike_price double, tradable boolean, "
        "chain_pos int")
    held = spark.createDataFrame([], "symbol string, asset_class string, qty double, market_value double")
    got = rows(hedging.hedge_plan(requests, chain, quotes, held), "portfolio_id")
    assert [got[p].reason for p in "abc"] == [None, "no_quote", "no_contract"]
    assert got["a"].contracts_to_buy > 0 and got["b"].contracts_to_buy == got["c"].contracts_to_buy == 0


def test_quantile_is_exact_beyond_the_sketch(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), (F.col("id") ** 2 % 99_991).cast("double").alias("v"))
    want = {g: np.median([i * i % 99_991 for i in range(g, 200_000, 2)]) for g in (0, 1)}
    for accuracy in (quantiles.ACCURACY, 3):        # with a poor sketch the rank is outside its bracket
        quantiles.ACCURACY, before = accuracy, quantiles.ACCURACY
        got = rows(quantiles.grouped_median(df, ["g"], "v", "m"), "g")
        quantiles.ACCURACY = before
        assert {g: r.m for g, r in got.items()} == want
