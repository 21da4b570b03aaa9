"""Whole-universe discounted-cash-flow valuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import valuation as V
from tidemark.functions.numeric import fence, first_reason, is_finite, ratio
from tidemark.operators import asof
from tidemark.operators.fundamentals import capital_input_error, valuation_inputs
from tidemark.params import DcfParams, ScanParams


def _assumptions(p: DcfParams, growth=None, margin=None, terminal_growth=None) -> dict:
    """Resolve each assumption once: explicit, else historical, else default."""

    def explicit(column, scalar):
        return F.col(column) if column else F.lit(scalar).cast("double")

    return {
        "growth": F.coalesce(
            explicit(growth, p.growth), F.col("growth_hist"), F.lit(p.default_growth)
        ),
        "margin": F.coalesce(
            explicit(margin, p.margin), F.col("margin_hist"), F.lit(p.default_margin)
        ),
        "tax_rate": F.coalesce(
            explicit(None, p.tax_rate), F.col("tax_derived"), F.lit(p.default_tax)
        ),
        "terminal_growth": explicit(terminal_growth, p.terminal_growth),
    }


def assumption_columns(df: DataFrame, p: DcfParams, **overrides) -> DataFrame:
    return df.withColumns(_assumptions(p, **overrides))


def value_companies(df: DataFrame, p: DcfParams = DcfParams(), **overrides) -> DataFrame:
    """Add the valuation columns to rows carrying price, shares, risk_free, beta and inputs.

    Narrow: one select whose later columns refer to earlier ones. The explicit years are
    unrolled in the expression.
    """
    base = F.when(F.col("revenue") > 0, F.col("revenue"))
    last = V.fcf_in("revenue", "growth", "margin", "tax_rate", F.lit(float(p.years)), p)
    explicit = V.pv_fcf_sum("revenue", "growth", "margin", "tax_rate", "wacc", p)
    market_ev = V.market_enterprise_value("price", "shares", "total_debt", "cash")
    debt, cash = F.coalesce("total_debt", F.lit(0.0)), F.coalesce("cash", F.lit(0.0))
    added = {
        **_assumptions(p, **overrides),
        "wacc": V.wacc(
            "price", "shares", "total_debt", "beta", "risk_free", "debt_cost", "tax_rate", p
        ),
        "final_fcf": F.when(base.isNotNull(), last),
        "terminal_value": V.terminal_value("final_fcf", "wacc", "terminal_growth"),
        "pv_explicit_fcf": F.when(base.isNotNull(), explicit),
        "pv_terminal_value": F.col("terminal_value") / F.pow(1 + F.col("wacc"), float(p.years)),
        "enterprise_value": F.col("pv_explicit_fcf") + F.col("pv_terminal_value"),
        "equity_value": F.col("enterprise_value") - debt + cash,
        "intrinsic_value": F.when(F.col("shares") > 0, ratio("equity_value", "shares")),
        "market_enterprise_value": market_ev,
        "fcf_yield": V.fcf_yield("ocf", "capex", "market_enterprise_value"),
        "dcf_error": dcf_error(),
    }
    return fence(df.select("*", *[c.alias(n) for n, c in added.items()]), list(added))


def dcf_error() -> Column:
    """Why a valuation could not be produced, in evaluation order."""
    return F.coalesce(
        capital_input_error(),
        first_reason(
            (F.col("revenue").isNull(), "no_revenue"),
            (F.col("price").isNull() | (F.col("price") <= 0), "price_not_positive"),
            (F.col("shares").isNull() | (F.col("shares") <= 0), "shares_not_positive"),
            (F.col("beta").isNotNull() & ~is_finite("beta"), "invalid_beta"),
            (F.col("wacc").isNull(), "no_wacc"),
            (F.col("revenue") <= 0, "revenue_not_positive"),
            (F.col("wacc") <= F.col("terminal_growth"), "wacc_not_above_growth"),
            (~is_finite("enterprise_value"), "value_not_finite"),
        ),
    )


def project_cash_flows(df: DataFrame, p: DcfParams = DcfParams()) -> DataFrame:
    """One row per projected year, from the closed form."""
    rows = df.filter("revenue > 0").withColumn(
        "year", F.explode(F.sequence(F.lit(1), F.lit(p.years)))
    )
    return rows.withColumns(_projected(F.col("year").cast("double"), p))


def _projected(year: Column, p: DcfParams) -> dict:
    now, before = V.revenue_in("revenue", "growth", year), V.revenue_in("revenue", "growth", year - 1)
    return {
        "projected_revenue": now,
        "projected_ebit": now * F.col("margin"),
        "nopat": now * F.col("margin") * (1 - F.col("tax_rate")),
        "da": now * p.da_pct,
        "projected_capex": now * p.capex_pct,
        "change_in_nwc": (now - before) * p.nwc_pct,
        "fcf": V.fcf_in("revenue", "growth", "margin", "tax_rate", year, p),
    }


def projection(p: DcfParams = DcfParams()) -> Column:
    """The projected years of a row as an array of structs."""
    return F.array(*[F.struct(F.lit(y).alias("year"), *[
        c.alias(n) for n, c in _projected(F.lit(float(y)), p).items()]) for y in range(1, p.years + 1)])


def market_rows(companies: DataFrame, statements: DataFrame, prices: DataFrame, shares: DataFrame,
                splits: DataFrame, dates, p: DcfParams = DcfParams(),
                s: ScanParams = ScanParams(), macro: DataFrame | None = None,
                rf_ticker="^RF") -> DataFrame:
    """Universe x dates with every point-in-time input attached.

    macro holds the yield series; without it the series is taken from prices.
    """
    from datetime import date, timedelta

    cuts = [
        (d, (date.fromisoformat(str(d)) - timedelta(days=s.filing_lag_days)).isoformat())
        for d in dates
    ]
    quotes = prices if macro is not None else prices.filter(F.col("ticker") != rf_ticker)
    universe = companies.select(
        "ticker", "beta", "universe_pos",
        F.coalesce(F.nullif("sector", F.lit("")), F.lit("Unknown")).alias("sector"),
        F.explode(F.array(*[F.lit(d).cast("date") for d in dates])).alias("as_of"),
    )
    key = ["ticker", "as_of"]
    return (
        universe
        .join(valuation_inputs(statements, cuts, p), key, "left")
        .join(asof.as_of_price(quotes, dates, s), key, "left")
        .join(asof.as_of_shares(shares, splits, companies, dates, s), key, "left")
        .join(asof.risk_free(prices if macro is None else macro, dates, rf_ticker, s), "as_of", "left")
    )


VALUATION_COLUMNS = (
    "ticker", "as_of", "sector", "universe_pos", "price", "intrinsic_value", "price_to_intrinsic",
    "wacc", "beta", "fcf_yield", "tax_rate", "fcf_growth", "roic", "skip_reason",
    "approximations",
)


def valuations(rows: DataFrame, p: DcfParams = DcfParams()) -> DataFrame:
    """Point-in-time valuation with ordered skip reasons; skipped rows keep only their keys."""
    v = value_companies(rows, p)
    iv = F.col("intrinsic_value")
    piv = F.when(iv > 0, ratio("price", iv))
    reason = F.coalesce(
        first_reason(
            (F.col("income_period").isNull() | F.col("balance_period").isNull(), "no_statements"),
            (~is_finite("price"), "no_price"),
            (F.col("shares").isNull(), "no_shares"),
        ),
        F.col("dcf_error"),
        first_reason(
            (~is_finite("intrinsic_value") | (iv <= 0), "intrinsic_value_not_positive"),
            (~is_finite("price_to_intrinsic"), "ratio_not_finite"),
        ),
    )
    v = v.select(
        "*", piv.alias("price_to_intrinsic"),
        V.roic("ebit", "tax_rate", "total_debt", "equity", "cash").alias("roic"),
        reason.alias("skip_reason"),
    )
    kept = F.col("skip_reason").isNull()
    notes = F.array_compact(F.array(
        F.lit("beta"), F.lit("sector"),
        F.when(F.col("shares_approximated"), F.lit("shares_outstanding")),
    ))
    values = ("price", "intrinsic_value", "price_to_intrinsic", "wacc", "beta", "fcf_yield",
              "tax_rate", "fcf_growth", "roic")
    row = F.struct(
        "skip_reason", F.when(kept, notes).otherwise(F.array().cast("array<string>"))
        .alias("approximations"), *[F.when(kept, F.col(c)).alias(c) for c in values],
    )
    out = v.select("ticker", "as_of", "sector", "universe_pos", F.inline(F.array(row)))
    return out.select(*VALUATION_COLUMNS)
