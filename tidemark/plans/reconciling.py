"""Second valuation, comparisons, sensitivity reconciliation and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import (
    fundamentals as fu, reconcile as rc, second_opinion as so, sensitivity as se, valuation as va,
)
from tidemark.params import DcfParams
from tidemark.plans.common import market_rows
from tidemark.plans.registry import query
from tidemark.session import land

DAY = fx.AS_OF[1]
P = DcfParams()

PRODUCED = {
    "revenue_cagr": "growth", "operating_margin": "margin", "wacc": "wacc",
    **{f"fcf_year_{y}": f"fcf_{y}" for y in range(1, 6)},
    "terminal_value": "terminal_value", "pv_explicit_fcf": "pv_explicit_fcf",
    "pv_terminal_value": "pv_terminal_value", "enterprise_value": "enterprise_value",
    "equity_value": "equity_value", "intrinsic_value_per_share": "intrinsic_value",
}
EXPECTED = {**PRODUCED, "revenue_cagr": "capped_cagr", "operating_margin": "avg_margin"}


def landed_inputs(t):
    """Market rows and the income periods behind them, read by both valuations."""
    periods = land(fu.fold_periods(t.statements), "periods")
    return land(market_rows(t, (DAY,), periods), "market-rows"), periods


def produced_rows(inputs):
    """The library's valuation on one date, landed because several comparisons read it."""
    from tidemark.functions import valuation as V

    v = va.value_companies(inputs[0], P).filter("dcf_error is null")
    flows = {
        f"fcf_{y}": V.fcf_in("revenue", "growth", "margin", "tax_rate", F.lit(float(y)), P)
        for y in range(1, 6)
    }
    return land(v.withColumns(flows), "produced")


def second_inputs(inputs):
    rows, periods = inputs
    income = fu.statement_periods(periods.filter("statement = 'income'"))
    history = income.filter("revenue is not null").select(
        "ticker", F.unix_date("period_end").alias("day_no"), "revenue", "ebit"
    )
    latest = rows.select(
        "ticker", "pretax", "tax_provision", "interest", "total_debt", "cash", "price", "shares",
        "beta", "risk_free",
    )
    return history, latest


def expected_rows(inputs, rule="periods"):
    """The second formulation; counting periods instead of days makes small real gaps."""
    history, latest = second_inputs(inputs)
    return land(so.second_dcf(history, latest, rule).filter("wacc is not null"), "expected")


def both_sides(t):
    inputs = landed_inputs(t)
    return produced_rows(inputs), expected_rows(inputs)


def base_comparison(sides):
    produced, expected = sides
    return rc.compare(rc.melt_metrics(produced, PRODUCED), rc.melt_metrics(expected, EXPECTED))


def _cells(df, prefix=""):
    names = sorted({o for outs in se.OUTPUTS.values() for o in outs})
    return df.select("ticker", F.lit(DAY).alias("as_of"), "table_no", "pos",
                     *[F.col(f"{prefix}{n}").alias(n) for n in names])


def cell_comparison(sides):
    produced = se.melt(_cells(se.sensitivity(sides[0], P))).drop("as_of")
    expected = se.melt(_cells(so.second_cells(sides[1]), "cell_")).drop("as_of")
    return land(rc.compare_cells(produced, expected), "cells")


@query(money=("terminal_value", "pv_explicit_fcf", "pv_terminal_value", "enterprise_value",
              "equity_value"))
def x23_second_dcf(t):
    history, latest = second_inputs(landed_inputs(t))
    v = so.second_dcf(history, latest, "days")
    return v.select("ticker", "raw_cagr", "capped_cagr", "avg_margin", "tax_used", "tax_method",
                    "debt_cost_used", "debt_method", "raw_wacc", "wacc", "terminal_value",
                    "pv_explicit_fcf", "pv_terminal_value", "enterprise_value", "equity_value",
                    "intrinsic_value")


COMPARED_MONEY = ("produced", "expected", "absolute_difference")


@query(money=COMPARED_MONEY)
def j12_full_outer_compare(t):
    """One side loses some rows, which must show as unmatched."""
    produced, expected = both_sides(t)
    produced = rc.melt_metrics(produced, PRODUCED).filter("ticker not like '%5'")
    expected = rc.melt_metrics(expected, EXPECTED).filter("ticker not like '%7'")
    return rc.compare(produced, expected).select(
        "ticker", "metric", "produced", "expected", "passed"
    )


@query(money=COMPARED_MONEY)
def l3_tolerance_compare(t):
    return base_comparison(both_sides(t)).select("ticker", "metric", "difference_kind", "tolerance", "passed")


@query()
def l5_base_reconciliation(t):
    return rc.first_divergence(base_comparison(both_sides(t)))


def shifted_comparison(t):
    """The discount rate of every tenth company is one point off."""
    produced, expected = both_sides(t)
    off = produced.withColumn("wacc", F.col("wacc") + F.when(
        F.substring("ticker", -1, 1) == "3", 0.01).otherwise(0.0))
    return rc.compare(rc.melt_metrics(off, PRODUCED), rc.melt_metrics(expected, EXPECTED))


@query()
def w15_first_divergence(t):
    return rc.first_divergence(shifted_comparison(t))


@query()
def a13_directional_bias(t):
    """Both sides are sums in different orders, so differences of a billionth are left out."""
    return rc.directional_bias(base_comparison(both_sides(t)), noise=1e-9)


@query()
def l4_cell_compare(t):
    return cell_comparison(both_sides(t)).select("ticker", "table_no", "pos", "output", "kind", "passed")


@query()
def a15_coverage(t):
    return rc.coverage(cell_comparison(both_sides(t)))


@query()
def w14_monotonic(t):
    """Value per share falls along the WACC axis and rises along the others, for positive flows."""
    cells = se.sensitivity(produced_rows(landed_inputs(t)), P, tables=(1, 2, 3, 4))
    rows = cells.withColumn("rising", F.col("table_no") != 1)
    out = rc.monotonic(rows.select("ticker", "table_no", "pos", "intrinsic_value", "rising"),
                       ("ticker", "table_no"), "pos", "intrinsic_value", "rising")
    return out


@query()
def l6_sensitivity_reconciliation(t):
    c = cell_comparison(both_sides(t))
    return c.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("scalars"), F.count_if(~F.col("passed")).alias("failures"),
        F.bool_and("passed").alias("all_passed"),
    )


@query()
def a14_verdict(t):
    return rc.failing_companies(shifted_comparison(t))


@query()
def l16_reconciliation_run(t):
    sides = both_sides(t)
    return rc.verdict(base_comparison(sides), cell_comparison(sides))


@query()
def l7_error_injection(t):
    return rc.mutation_check(produced_rows(landed_inputs(t))).select(
        "ticker", "metric", "difference", "tolerance", "detected"
    )


@query()
def l15_fiscal_calendar(t):
    """Every sixth company's last period is moved three months."""
    moved = t.statements.withColumn("period_end", F.when(
        (F.substring("ticker", 2, 5).cast("int") % 6 == 0)
        & (F.col("period_end") == F.lit("2000-12-31").cast("date")),
        F.lit("2001-03-31").cast("date")).otherwise(F.col("period_end")))
    return rc.calendar_irregularity(moved)
