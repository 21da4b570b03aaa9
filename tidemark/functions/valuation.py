"""Discounted-cash-flow arithmetic as column expressions (no shuffle, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.numeric import clamp, col, is_finite, nonzero, ratio
from tidemark.params import DcfParams


def effective_tax_rate(pretax, provision) -> Column:
    rate = ratio(provision, nonzero(pretax))
    return F.when((rate >= 0) & (rate < 1), rate)


def cost_of_debt(interest, debt) -> Column:
    return ratio(F.abs(nonzero(interest)), nonzero(debt))


def revenue_cagr(first, last, first_date, last_date) -> Column:
    years = F.datediff(col(last_date), col(first_date)) / F.lit(365.25)
    ok = (col(first) > 0) & (col(last) > 0) & (years > 0)
    return F.when(ok, F.pow(col(last) / col(first), F.lit(1.0) / years) - 1)


def raw_wacc(price, shares, debt, beta, risk_free, premium, debt_cost, tax) -> Column:
    cap = col(price) * col(shares)
    total = cap + col(debt)
    equity_cost = col(risk_free) + col(beta) * col(premium)
    return (cap / total) * equity_cost + (col(debt) / total) * (col(debt_cost) * (1 - col(tax)))


def wacc(price, shares, debt, beta, risk_free, debt_cost, tax, p: DcfParams) -> Column:
    """Capital-weighted cost of capital; missing inputs default, invalid ones give null."""
    debt0 = F.coalesce(col(debt), F.lit(0.0))
    beta0 = F.coalesce(col(beta), F.lit(p.default_beta))
    kd = F.coalesce(col(debt_cost), F.lit(p.default_cost_of_debt))
    tax0 = F.coalesce(col(tax), F.lit(p.default_tax))
    raw = raw_wacc(price, shares, debt0, beta0, risk_free, F.lit(p.market_premium), kd, tax0)
    ok = (
        (col(price) > 0) & (col(shares) > 0) & (debt0 >= 0) & (kd >= 0)
        & (tax0 >= 0) & (tax0 < 1) & is_finite(price) & is_finite(shares)
    )
    value = F.when(ok, raw)
    return clamp(F.when(is_finite(value), value), p.min_wacc, p.max_wacc)


def revenue_in(base, growth, year) -> Column:
    return col(base) * F.pow(1 + col(growth), year)


def fcf_in(base, growth, margin, tax, year, p: DcfParams) -> Column:
    """Free cash flow of one projected year, from the closed form of the compounding loop."""
    now = revenue_in(base, growth, year)
    before = revenue_in(base, growth, year - 1)
    nopat = now * col(margin) * (1 - col(tax))
    return nopat + now * p.da_pct - now * p.capex_pct - (now - before) * p.nwc_pct


def pv_fcf_sum(base, growth, margin, tax, rate, p: DcfParams) -> Column:
    total = F.lit(0.0)
    for year in range(1, p.years + 1):
        flow = fcf_in(base, growth, margin, tax, F.lit(float(year)), p)
        total = total + flow / F.pow(1 + col(rate), F.lit(float(year)))
    return total


def terminal_value(final_fcf, rate, growth) -> Column:
    spread = col(rate) - col(growth)
    return F.when(spread > 0, col(final_fcf) * (1 + col(growth)) / spread)


def market_enterprise_value(price, shares, debt, cash) -> Column:
    debt0, cash0 = F.coalesce(col(debt), F.lit(0.0)), F.coalesce(col(cash), F.lit(0.0))
    ok = (
        is_finite(price) & (col(price) > 0) & is_finite(shares) & (col(shares) > 0)
        & is_finite(debt0) & (debt0 >= 0) & is_finite(cash0) & (cash0 >= 0)
    )
    return F.when(ok, col(price) * col(shares) + debt0 - cash0)


def fcf_yield(ocf, capex, ev) -> Column:
    ok = is_finite(ocf) & is_finite(capex) & is_finite(ev) & (col(ev) > 0)
    return F.when(ok, (col(ocf) + col(capex)) / col(ev))


def roic(ebit, tax, debt, equity, cash) -> Column:
    capital = F.coalesce(col(debt), F.lit(0.0)) + col(equity) - F.coalesce(col(cash), F.lit(0.0))
    return F.when(capital > 0, col(ebit) * (1 - col(tax)) / capital)


def saturate(raw, cap, half) -> Column:
    return F.when(col(raw) <= 0, F.lit(0.0)).otherwise(cap * col(raw) / (col(raw) + half))
