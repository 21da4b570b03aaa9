"""Fundamental ratios and the discounted-cash-flow chain."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.functions import valuation as V
from tidemark.operators import fundamentals as fu, screens, sensitivity as se, valuation as va
from tidemark.params import DcfParams, GateParams
from tidemark.plans.common import market_rows
from tidemark.plans.registry import query

P = DcfParams()


def _cuts(dates=fx.AS_OF, lag=90):
    return [(d, (date.fromisoformat(d) - timedelta(days=lag)).isoformat()) for d in dates]


def _inputs(t):
    return fu.valuation_inputs(t.statements, _cuts())


def _valued(t):
    return va.value_companies(market_rows(t), P)


@query()
def a5_average_margin(t):
    return _inputs(t).select("ticker", "as_of", "margin_hist")


@query()
def a6_revenue_cagr(t):
    return _inputs(t).select("ticker", "as_of", "revenue_cagr")


@query()
def w2_fcf_growth(t):
    return _inputs(t).select("ticker", "as_of", "fcf_growth")


@query()
def x1_effective_tax(t):
    return _inputs(t).select("ticker", "as_of", "tax_derived")


@query()
def x2_cost_of_debt(t):
    return _inputs(t).select("ticker", "as_of", "debt_cost")


@query()
def x3_valuation_inputs(t):
    return _inputs(t).drop("income_period", "balance_period", "cash_flow_period")


@query()
def x4_wacc(t):
    v = va.assumption_columns(market_rows(t), P)
    rate = V.wacc("price", "shares", "total_debt", "beta", "risk_free", "debt_cost", "tax_rate", P)
    return v.select("ticker", "as_of", rate.alias("wacc"))


@query()
def x5_tax_precedence(t):
    """Derived rate, the default where none exists, and an explicit override."""
    base = va.assumption_columns(_inputs(t), P).select("ticker", "as_of", "tax_rate")
    fixed = va.assumption_columns(_inputs(t), DcfParams(tax_rate=0.3)).select(
        "ticker", "as_of", F.col("tax_rate").alias("tax_override")
    )
    return base.join(fixed, ["ticker", "as_of"])


FLOW_MONEY = ("projected_revenue", "projected_ebit", "nopat", "da", "projected_capex",
              "change_in_nwc", "fcf")


@query(money=FLOW_MONEY)
def x6_cash_flow_projection(t):
    rows = va.assumption_columns(_inputs(t), P)
    return va.project_cash_flows(rows, P).select("ticker", "as_of", "year", *FLOW_MONEY)


@query(money=("terminal_value",))
def x7_terminal_value(t):
    return _valued(t).select("ticker", "as_of", "terminal_value")


@query(money=("pv_explicit_fcf", "pv_terminal_value", "enterprise_value"))
def x8_discounting(t):
    return _valued(t).select("ticker", "as_of", "pv_explicit_fcf", "pv_terminal_value",
                             "enterprise_value")


@query(money=("equity_value",))
def x9_equity_bridge(t):
    return _valued(t).select("ticker", "as_of", "equity_value", "intrinsic_value")


@query(money=("market_enterprise_value",))
def x10_market_enterprise_value(t):
    return _valued(t).select("ticker", "as_of", "market_enterprise_value")


@query()
def x11_fcf_yield(t):
    return _valued(t).select("ticker", "as_of", "fcf_yield")


DCF_MONEY = ("terminal_value", "pv_explicit_fcf", "pv_terminal_value", "enterprise_value",
             "equity_value", "market_enterprise_value")


@query(money=DCF_MONEY)
def x12_full_dcf(t):
    return _valued(t).select(
        "ticker", "as_of", "wacc", "growth", "margin", "tax_rate", *DCF_MONEY, "intrinsic_value",
        "price", "fcf_yield",
    )


@query()
def x13_point_in_time_valuation(t):
    v = va.valuations(market_rows(t), P)
    return v.withColumn("approximations", F.array_join("approximations", ","))


@query()
def x14_roic(t):
    v = va.assumption_columns(_inputs(t), P)
    return v.select("ticker", "as_of",
                    V.roic("ebit", "tax_rate", "total_debt", "equity", "cash").alias("roic"))


@query()
def x18_altman_z(t):
    q = screens.quality_scores(t.companies, t.statements, [(fx.AS_OF[1], fx.AS_OF[1])])
    return q.select("ticker", "as_of", "altman_z", screens.altman_zone("altman_z").alias("zone"))


@query()
def x19_f_score(t):
    q = screens.quality_scores(t.companies, t.statements, [(fx.AS_OF[1], fx.AS_OF[1])])
    return q.select("ticker", "as_of", F.col("f_score").cast("bigint").alias("f_score"))


@query()
def f10_altman_gate(t):
    """The sector names of the data are none of the exempt ones, so one is made exempt."""
    from tidemark.operators.scan import altman_fails

    q = screens.quality_scores(t.companies, t.statements, [(fx.AS_OF[1], fx.AS_OF[1])])
    sector = t.companies.select("ticker", "sector")
    g = GateParams(altman_exempt=("ASIA",))
    j = sector.join(q, "ticker", "left")
    fails = F.coalesce(altman_fails("altman_z", "sector", g), F.lit(True))
    return j.select("ticker", fails.alias("rejected"))


@query()
def f17_altman_zone(t):
    logs = t.trade_logs
    return logs.select("event_id", screens.altman_zone("altman_z_score").alias("zone"))


SENSITIVITY_MONEY = ("fcf_1", "fcf_2", "fcf_3", "fcf_4", "fcf_5", "terminal_value",
                     "enterprise_value", "equity_value")


@query(money=SENSITIVITY_MONEY)
def x20_sensitivity_tables(t):
    """Tables 1 to 4: one input varied at a time."""
    return se.sensitivity(_valued(t), P, tables=(1, 2, 3, 4))


@query()
def x21_two_way_grid(t):
    return se.sensitivity(_valued(t), P, tables=(5,)).select(
        "ticker", "as_of", "x_wacc", "x_terminal", "intrinsic_value"
    )


@query()
def x22_recovered_tax(t):
    flows = va.project_cash_flows(va.assumption_columns(_inputs(t), P), P)
    return se.recovered_tax(flows)


@query()
def x25_risk_density(t):
    snaps = t.trade_logs.filter("var_95 is not null")
    return se.risk_density(snaps).select("event_id", "bin", "x", "density")


@query(money=tuple(f"fcf_{y}" for y in range(1, 6)))
def l14_captured_outputs(t):
    """Projected flows nested per company as a year -> value map, read back in year order."""
    flows = va.project_cash_flows(va.assumption_columns(_inputs(t), P), P)
    nested = flows.groupBy("ticker", "as_of").agg(
        F.map_from_entries(F.collect_list(F.struct("year", "fcf"))).alias("fcf")
    )
    return nested.select(
        "ticker", "as_of", F.size("fcf").cast("bigint").alias("years"),
        *[F.col("fcf")[y].alias(f"fcf_{y}") for y in range(1, 6)],
    )


@query()
def w4_trend_filter(t):
    return screens.trend_filter(t.company_prices, fx.AS_OF[1])


@query()
def w5_wilder_rsi(t):
    return screens.wilder_rsi(t.company_prices, fx.AS_OF[1])


@query()
def w5_wilder_rsi_year(t):
    """The same index over a year of closes."""
    return screens.wilder_rsi(t.company_prices, fx.AS_OF[1], GateParams(rsi_months=12))
