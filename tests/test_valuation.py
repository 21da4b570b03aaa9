"""Valuation arithmetic: golden companies, fallbacks, refusals and point-in-time rules."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark import schemas
from tidemark.functions import valuation as V
from tidemark.operators import asof, fundamentals as fu, scan, sensitivity as se, valuation as va
from tidemark.params import DcfParams

# Published annual figures of four companies (USD) and market data.
COMPANIES = {
    "MSFT": dict(
        history=[("2022-06-30", 198270e6, 83383e6), ("2023-06-30", 211915e6, 88523e6),
                 ("2024-06-30", 245122e6, 109433e6), ("2025-06-30", 281724e6, 128528e6),
                 ("2026-06-30", 331839e6, 155237e6)],
        pretax=165934e6, tax=32185e6, interest=3051e6, debt=40294e6, cash=20935e6,
        price=479.78, shares=7425545491.0, beta=1.099),
    "CAT": dict(
        history=[("2021-12-31", 50971e6, 6878e6), ("2022-12-31", 59427e6, 7904e6),
                 ("2023-12-31", 67060e6, 12966e6), ("2024-12-31", 64809e6, 13072e6),
                 ("2025-12-31", 67589e6, 11151e6)],
        pretax=11541e6, tax=2768e6, interest=1842e6, debt=36210e6, cash=9980e6,
        price=886.0, shares=459674889.0, beta=1.605),
    "INTC": dict(
        history=[("2021-12-25", 79024e6, 19456e6), ("2022-12-31", 63054e6, 2334e6),
                 ("2023-12-30", 54228e6, 93e6), ("2024-12-28", 53101e6, -11678e6),
                 ("2025-12-27", 52853e6, -2214e6)],
        pretax=1557e6, tax=1531e6, interest=1091e6, debt=46585e6, cash=14265e6,
        price=104.125, shares=5286105262.0, beta=2.241),
    "VZ": dict(
        history=[("2021-12-31", 133613e6, 32448e6), ("2022-12-31", 136835e6, 30467e6),
                 ("2023-12-31", 133974e6, 22877e6), ("2024-12-31", 134788e6, 28686e6),
                 ("2025-12-31", 138191e6, 29259e6)],
        pretax=22672e6, tax=5064e6, interest=6694e6, debt=158150e6, cash=19048e6,
        price=48.155, shares=4154775202.0, beta=0.231),
}
# Growth %, margin %, WACC %, enterprise value, value per share.
GOLDEN = {
    "MSFT": (13.741147, 44.175047, 10.000422, 2481796806080.1045, 331.6171),
    "CAT": (7.309511, 16.559502, 12.095875, 101083871479.2405, 162.8409),
    "INTC": (-9.554417, 0.462485, 15.054645, -2353816817.4252, -6.5594),
    "VZ": (0.845787, 21.216289, 5.0, 811105640623.6685, 161.7425),
}


def d(s):
    return date.fromisoformat(s)


def golden_rows(spark):
    st, mk = [], []
    for t, c in COMPANIES.items():
        last = c["history"][-1][0]
        for p, r, e in c["history"]:
            st += [(t, "income", "Total Revenue", d(p), r), (t, "income", "EBIT", d(p), e)]
        for item, v in (("Pretax Income", "pretax"), ("Tax Provision", "tax"),
                        ("Interest Expense", "interest")):
            st.append((t, "income", item, d(last), c[v]))
        st += [(t, "balance", "Total Debt", d(last), c["debt"]),
               (t, "balance", "Cash And Cash Equivalents", d(last), c["cash"])]
        mk.append((t, c["price"], c["shares"], c["beta"], 0.04))
    statements = spark.createDataFrame(st, schemas.STATEMENTS)
    market = spark.createDataFrame(
        mk, "ticker string, price double, shares double, beta double, risk_free double")
    inputs = fu.valuation_inputs(statements, [("2026-12-31", "2026-12-31")])
    return inputs.join(market, "ticker")


def test_golden_companies(spark):
    got = rows(va.value_companies(golden_rows(spark)), "ticker")
    for t, (growth, margin, wacc, ev, iv) in GOLDEN.items():
        r = got[t]
        assert r.dcf_error is None
        assert round(r.growth * 100, 6) == growth
        assert round(r.margin * 100, 6) == margin
        assert round(r.wacc * 100, 6) == wacc
        assert math.isclose(r.enterprise_value, ev, rel_tol=1e-9)
        assert round(r.intrinsic_value, 4) == iv
        assert r.fcf_yield is None  # no cash-flow statement


def test_golden_sensitivity_shape_and_direction(spark):
    cells = se.sensitivity(va.value_companies(golden_rows(spark)))
    melted = se.melt(cells)
    assert {r["count"] for r in melted.groupBy("ticker").count().collect()} == {227}
    by = {}
    for r in cells.filter("table_no = 1").collect():
        by.setdefault(r.ticker, []).append((r.x_wacc, r.intrinsic_value))
    for t, pairs in by.items():
        values = [v for _, v in sorted(pairs)]
        step = [b - a for a, b in zip(values, values[1:])]
        if t == "INTC":  # negative flows: a higher rate hurts less
            assert all(s > 0 for s in step)
        else:
            assert all(s < 0 for s in step)
    # 5% rate against 5% growth has no value
    tie = cells.filter("table_no = 5 and x_wacc = 0.05 and x_terminal = 0.05").collect()
    assert len(tie) == 4 and all(r.intrinsic_value is None for r in tie)


def test_second_formulation_agrees(spark):
    from tidemark.operators import second_opinion as so

    first = rows(va.value_companies(golden_rows(spark)), "ticker")
    hist = [(t, (d(p) - date(1970, 1, 1)).days, r, e)
            for t, c in COMPANIES.items() for p, r, e in c["history"]]
    history = spark.createDataFrame(hist, "ticker string, day_no int, revenue double, ebit double")
    latest = golden_rows(spark).select(
        "ticker", "pretax", "tax_provision", "interest", "total_debt", "cash", "price", "shares",
        "beta", "risk_free")
    second = rows(so.second_dcf(history, latest), "ticker")
    assert math.isclose(second["VZ"].raw_wacc, 0.04394939, abs_tol=5e-9)
    for t in COMPANIES:
        assert math.isclose(first[t].intrinsic_value, second[t].intrinsic_value, rel_tol=1e-9)


def one(spark, **over):
    base = dict(price=50.0, shares=100.0, beta=1.0, risk_free=0.04, revenue=1000.0,
                growth_hist=0.05, margin_hist=0.2, tax_derived=0.3, debt_cost=None,
                total_debt=0.0, cash=0.0, ocf=None, capex=None)
    base.update(over)
    types = ", ".join(f"{k} double" for k in base)
    return va.value_companies(spark.createDataFrame([tuple(base.values())], types)).first()


@pytest.mark.parametrize("over, reason", [
    (dict(price=-1.0), "invalid_price"), (dict(shares=float("inf")), "invalid_shares"),
    (dict(total_debt=-1.0), "invalid_total_debt"), (dict(cash=float("nan")), "invalid_cash"),
    (dict(revenue=None), "no_revenue"), (dict(price=None), "price_not_positive"),
    (dict(price=0.0), "price_not_positive"), (dict(shares=0.0), "shares_not_positive"),
    (dict(beta=float("nan")), "invalid_beta"), (dict(revenue=0.0), "revenue_not_positive"),
])
def test_refusals(spark, over, reason):
    assert one(spark, **over).dcf_error == reason


def test_missing_inputs_take_defaults(spark):
    r = one(spark, beta=None, growth_hist=None, margin_hist=None, tax_derived=None,
            total_debt=None, cash=None)
    assert r.dcf_error is None
    assert (r.growth, r.margin, r.tax_rate) == (0.08, 0.15, 0.21)
    assert math.isclose(r.wacc, 0.095)


def test_wacc_is_clamped_but_never_invented(spark):
    assert one(spark, beta=10.0).wacc == 0.20
    assert one(spark, beta=-5.0).wacc == 0.05
    assert one(spark, price=None).wacc is None


def test_projection_matches_the_loop(spark):
    r = spark.createDataFrame([(1000.0, 0.07, 0.2, 0.25)],
                              "revenue double, growth double, margin double, tax_rate double")
    got = rows(va.project_cash_flows(r, DcfParams(years=7)), "year")
    rev = 1000.0
    for y in range(1, 8):
        prev, rev = rev, rev * 1.07
        fcf = rev * 0.2 * 0.75 + rev * 0.03 - rev * 0.04 - 0.01 * (rev - prev)
        assert math.isclose(got[y].fcf, fcf, rel_tol=1e-12)


@pytest.mark.parametrize("kwargs", [
    dict(years=0), dict(years=2.5), dict(years=True), dict(growth=0.41), dict(margin=-0.01),
    dict(terminal_growth=0.06), dict(tax_rate=1.0), dict(risk_free=float("nan")),
])
def test_bad_parameters_fail_on_the_driver(kwargs):
    with pytest.raises(ValueError):
        DcfParams(**kwargs)


def test_tax_rate_and_debt_cost(spark):
    df = spark.createDataFrame(
        [(100.0, 30.0, 5.0, 100.0), (0.0, 30.0, 0.0, 100.0), (100.0, -1.0, -5.0, 50.0),
         (100.0, 100.0, 5.0, 0.0)],
        "pretax double, tax double, interest double, debt double")
    got = df.select(V.effective_tax_rate("pretax", "tax"), V.cost_of_debt("interest", "debt")).collect()
    assert [tuple(r) for r in got] == [(0.3, 0.05), (None, None), (None, 0.1), (None, None)]


def statement_frame(spark, cells):
    return spark.createDataFrame(
        [(t, s, i, d(p), v) for t, s, i, p, v in cells], schemas.STATEMENTS)


def test_latest_period_is_per_statement_not_per_item(spark):
    st = statement_frame(spark, [
        ("A", "balance", "Cash And Cash Equivalents", "2022-12-31", 5.0),
        ("A", "balance", "Cash And Cash Equivalents", "2023-12-31", None),
        ("A", "balance", "Total Debt", "2023-12-31", 7.0),
        ("B", "balance", "Cash And Cash Equivalents", "2023-12-31", None),
        ("B", "balance", "CashAndCashEquivalents", "2023-12-31", 3.0),
    ])
    got = rows(fu.line_item_latest(st, "cash"), "ticker")
    assert got["A"].value is None  # no fall-back to the older year
    assert got["B"].value == 3.0   # labels coalesce within the period


def test_growth_keeps_to_the_first_label(spark):
    st = statement_frame(spark, [
        ("A", "income", "Total Revenue", "2022-12-31", None),
        ("A", "income", "TotalRevenue", "2022-12-31", 100.0),
        ("A", "income", "TotalRevenue", "2023-12-31", 200.0),
        ("B", "income", "TotalRevenue", "2022-12-31", 100.0),
        ("B", "income", "TotalRevenue", "2023-12-31", 110.0),
    ])
    got = rows(fu.valuation_inputs(st, [("2024-06-30", "2024-06-30")]), "ticker")
    assert got["A"].revenue == 200.0 and got["A"].revenue_cagr is None
    assert math.isclose(got["B"].revenue_cagr, 1.1 ** (365.25 / 365) - 1)


@pytest.mark.parametrize("as_of, visible", [("2024-03-20", 0), ("2024-03-29", 0), ("2024-03-30", 1)])
def test_filing_lag_boundary(spark, as_of, visible):
    st = statement_frame(spark, [("A", "income", "Total Revenue", "2023-12-31", 1000.0)])
    assert fu.periods_on_or_before(st, [as_of], 90).count() == visible


def test_lone_period_stands_for_its_own_prior(spark):
    st = statement_frame(spark, [
        ("A", "income", "Net Income", "2023-12-31", 10.0),
        ("A", "income", "Total Revenue", "2023-12-31", 100.0),
        ("A", "balance", "Total Assets", "2023-12-31", 50.0),
        ("A", "balance", "Share Issued", "2023-12-31", 5.0),
        ("A", "cash_flow", "Operating Cash Flow", "2023-12-31", 20.0),
    ])
    q = fu.quality_facts(st, [("2024-06-30", "2024-06-30")])
    # profitable, cash positive, cash above income and the non-strict dilution test
    assert q.select(fu.f_score().alias("f")).first().f == 4


def test_as_of_price_window_and_null_closes(spark):
    p = spark.createDataFrame(
        [("A", d("2024-01-01"), 1.0), ("A", d("2024-01-05"), None), ("B", d("2024-01-10"), 9.0)],
        schemas.PRICES)
    got = rows(asof.as_of_price(p, ["2024-01-11", "2024-01-12", "2024-01-09"]), "ticker", "as_of")
    assert got[("A", d("2024-01-11"))].price == 1.0  # ten days back, inclusive
    assert ("A", d("2024-01-12")) not in got
    assert ("B", d("2024-01-09")) not in got         # never the future
    assert got[("B", d("2024-01-12"))].price_date == d("2024-01-10")


def test_dense_as_of_equals_the_grid_form(spark):
    import random

    rng = random.Random(3)
    days = [date.fromordinal(d("2020-01-01").toordinal() + i) for i in range(120)]
    quotes = [(t, day, rng.choice([None, rng.random()])) for t in "AB" for day in days
              if rng.random() < 0.15]
    p = spark.createDataFrame(quotes, schemas.PRICES)
    req = spark.createDataFrame([(t, day) for t in "AB" for day in days], "ticker string, as_of date")
    got = rows(asof.as_of_price_dense(p, req, 10), "ticker", "as_of")
    for t in "AB":
        for day in days:
            seen = [(q[1], q[2]) for q in quotes if q[0] == t and q[2] is not None
                    and 0 <= (day - q[1]).days <= 10]
            want = max(seen)[1] if seen else None
            assert got[(t, day)].price == want


def test_shares_are_split_adjusted_or_flagged(spark):
    companies = spark.createDataFrame(
        [("A", None, None, 1.0, 1.0, 1.0, 500.0, 0), ("B", None, None, 1.0, 1.0, 1.0, 700.0, 1)],
        schemas.COMPANIES)
    sh = spark.createDataFrame([("A", d("2023-06-01"), 100.0)], schemas.SHARES)
    sp = spark.createDataFrame(
        [("A", d("2023-12-31"), 9.0), ("A", d("2024-01-01"), 2.0), ("A", d("2024-05-01"), 3.0),
         ("A", d("2024-06-01"), 0.0), ("A", d("2024-07-01"), None)], schemas.SPLITS)
    got = rows(asof.as_of_shares(sh, sp, companies, ["2023-12-31"]), "ticker")
    assert (got["A"].shares, got["A"].shares_approximated) == (600.0, False)
    assert (got["B"].shares, got["B"].shares_approximated) == (700.0, True)


def scored(spark, cells):
    v = spark.createDataFrame(
        [(t, d("2024-01-01"), s, i, 10.0, 20.0, piv, 0.08, 1.0, y, 0.21, g, r, skip, ["beta"])
         for i, (t, s, piv, g, r, y, skip) in enumerate(cells)],
        "ticker string, as_of date, sector string, universe_pos int, price double, "
        "intrinsic_value double, price_to_intrinsic double, wacc double, beta double, "
        "fcf_yield double, tax_rate double, fcf_growth double, roic double, skip_reason string, "
        "approximations array<string>")
    return scan.score(v, scan.sector_medians(v))


def test_scoring_branches(spark):
    got = scored(spark, [
        ("GOOD", "T", 0.5, 0.5, 0.1, 0.3, None),
        ("DEAR", "T", 2.0, 0.5, 0.1, 0.3, None),
        ("BOTHNEG", "T", 0.6, -0.5, -0.2, 0.3, None),
        ("NOGROWTH", "T", 0.6, None, 0.1, 0.3, None),
        ("NOROIC", "T", 0.6, 0.2, None, 0.3, None),
        ("SKIPPED", "T", None, None, None, None, "no_price"),
        ("CHEAP", "U", 0.01, 0.5, 0.1, None, None),
    ])
    g = rows(got, "ticker")
    raw = 0.5 * 0.1 / 0.5
    assert math.isclose(g["GOOD"].conviction, 2 * raw / (raw + 0.1))
    assert g["DEAR"].skip_reason == "above_sector_median" and g["DEAR"].fcf_growth is None
    assert g["BOTHNEG"].skip_reason == "not_compounding" and g["BOTHNEG"].conviction is None
    assert g["BOTHNEG"].roic == -0.2 and g["BOTHNEG"].beta is None
    assert g["NOGROWTH"].skip_reason == "no_fcf_growth"
    assert g["NOROIC"].skip_reason == "no_roic" and g["NOROIC"].fcf_growth is None
    assert g["SKIPPED"].skip_reason == "no_price" and g["SKIPPED"].sector_median is None
    floored = 0.5 * 0.1 / 0.05
    assert math.isclose(g["CHEAP"].conviction, 2 * floored / (floored + 0.1))
    b = rows(scan.blend_with_yield(got), "ticker")
    assert math.isclose(b["GOOD"].conviction, 0.6 * g["GOOD"].conviction + 0.4 * 2.0)
    assert math.isclose(b["CHEAP"].conviction, 0.6 * g["CHEAP"].conviction)


def test_ties_keep_universe_order(spark):
    cells = [(f"T{i}", "T", 0.5, 0.5, 0.1, 0.0, None) for i in range(6)]
    picks = scan.top_picks(scored(spark, cells), 3).orderBy("pick_rank").collect()
    assert [p.ticker for p in picks] == ["T0", "T1", "T2"]


def test_filters_on_results_stay_small(spark, data_dir):
    """A filter on a computed column must not copy the valuation expressions."""
    from tidemark.plans.common import market_rows
    from tidemark.plans.registry import Tables

    v = va.valuations(market_rows(Tables(spark, data_dir)))
    plan = v.filter("skip_reason is null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("POWER(") < 60
