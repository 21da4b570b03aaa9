"""An independent formulation of the valuation, kept as SQL expressions.

Each stage is a mapping of new column -> expression that may use earlier columns. Spark
applies a stage with selectExpr; any other SQL engine can nest the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

YEARS = 5

# Per-company history: one row per fiscal year with revenue, ebit and day_no (days since 1970).
HISTORY = {
    "rev_first": "min_by(revenue, day_no)",
    "rev_last": "max_by(revenue, day_no)",
    "day_first": "min(day_no)",
    "day_last": "max(day_no)",
    "years_listed": "count(*)",
    "avg_margin": "avg(CASE WHEN revenue > 0 THEN ebit / revenue END)",
}


def elapsed(rule: str) -> str:
    """'days' counts calendar days, 'periods' counts reported years."""
    return {"days": "(day_last - day_first) / 365.25e0", "periods": "(years_listed - 1) * 1e0"}[rule]


def dcf_stages(rule: str = "days") -> list[dict]:
    flow = {
        f"fcf_{y}": (
            f"rev_last * pow(1e0 + capped_cagr, {y}) * (avg_margin * (1e0 - tax_used) + 0.03e0 - 0.04e0)"
            f" - 0.01e0 * (rev_last * pow(1e0 + capped_cagr, {y}) - rev_last * pow(1e0 + capped_cagr, {y - 1}))"
        )
        for y in range(1, YEARS + 1)
    }
    pv = " + ".join(f"fcf_{y} / pow(1e0 + wacc, {y})" for y in range(1, YEARS + 1))
    return [
        {"years_elapsed": elapsed(rule)},
        {"raw_cagr": "CASE WHEN rev_first > 0 AND rev_last > 0 AND years_elapsed > 0 "
                     "THEN pow(rev_last / rev_first, 1e0 / years_elapsed) - 1e0 END",
         "tax_method": "CASE WHEN pretax IS NULL OR tax_provision IS NULL OR pretax = 0 THEN "
                       "'fallback:missing_or_zero_pretax' WHEN tax_provision / pretax >= 0 AND "
                       "tax_provision / pretax < 1 THEN 'derived' ELSE 'fallback:out_of_range' END",
         "debt_method": "CASE WHEN interest IS NULL OR total_debt IS NULL OR total_debt = 0 THEN "
                        "'fallback:missing_or_zero_debt' ELSE 'derived' END"},
        {"capped_cagr": "CASE WHEN raw_cagr > 0.25e0 THEN 0.25e0 ELSE raw_cagr END",
         "tax_used": "CASE WHEN tax_method = 'derived' THEN tax_provision / pretax ELSE 0.21e0 END",
         "debt_cost_used": "CASE WHEN debt_method = 'derived' THEN abs(interest) / total_debt ELSE 0.05e0 END",
         "debt_used": "coalesce(total_debt, 0e0)", "cash_used": "coalesce(cash, 0e0)",
         "beta_used": "coalesce(beta, 1e0)"},
        {"raw_wacc": "CASE WHEN price > 0 AND shares > 0 THEN "
                     "price * shares / (price * shares + debt_used) * (risk_free + beta_used * 0.055e0)"
                     " + debt_used / (price * shares + debt_used) * debt_cost_used * (1e0 - tax_used) END"},
        {"wacc": "CASE WHEN raw_wacc < 0.05e0 THEN 0.05e0 WHEN raw_wacc > 0.2e0 THEN 0.2e0 ELSE raw_wacc END"},
        flow,
        {"terminal_value": "CASE WHEN wacc > 0.025e0 THEN fcf_5 * 1.025e0 / (wacc - 0.025e0) END",
         "pv_explicit_fcf": pv},
        {"pv_terminal_value": "terminal_value / pow(1e0 + wacc, 5)"},
        {"enterprise_value": "pv_explicit_fcf + pv_terminal_value"},
        {"equity_value": "enterprise_value - debt_used + cash_used"},
        {"intrinsic_value": "equity_value / shares"},
    ]


def cell_stages() -> list[dict]:
    """Sensitivity cells from rows that carry s_wacc, s_terminal, s_growth and s_margin."""
    flow = {
        f"cell_fcf_{y}": (
            f"rev_last * pow(1e0 + x_growth, {y}) * (x_margin * (1e0 - tax_used) - 0.01e0)"
            f" - 0.01e0 * (rev_last * pow(1e0 + x_growth, {y}) - rev_last * pow(1e0 + x_growth, {y - 1}))"
        )
        for y in range(1, YEARS + 1)
    }
    pv = " + ".join(f"cell_fcf_{y} / pow(1e0 + x_wacc, {y})" for y in range(1, YEARS + 1))
    return [
        {"x_wacc": "coalesce(s_wacc, wacc)", "x_terminal": "coalesce(s_terminal, 0.025e0)",
         "x_growth": "coalesce(s_growth, capped_cagr)", "x_margin": "coalesce(s_margin, avg_margin)"},
        flow,
        {"cell_terminal_value": "CASE WHEN x_wacc > x_terminal THEN "
                                "cell_fcf_5 * (1e0 + x_terminal) / (x_wacc - x_terminal) END"},
        {"cell_enterprise_value": f"{pv} + cell_terminal_value / pow(1e0 + x_wacc, 5)"},
        {"cell_equity_value": "cell_enterprise_value - debt_used + cash_used"},
        {"cell_intrinsic_value": "cell_equity_value / shares"},
    ]


def apply(df: DataFrame, stages: list[dict]) -> DataFrame:
    for stage in stages:
        df = df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in stage.items()])
    return df


def as_sql(source: str, stages: list[dict]) -> str:
    """The same stages as nested SELECTs over a source relation."""
    out = source
    for stage in stages:
        cols = ", ".join(f"{sql} AS {name}" for name, sql in stage.items())
        out = f"SELECT *, {cols} FROM ({out})"
    return out


def history_sql(source: str) -> str:
    cols = ", ".join(f"{sql} AS {name}" for name, sql in HISTORY.items())
    return f"SELECT ticker, {cols} FROM ({source}) GROUP BY ticker"


def second_dcf(history: DataFrame, latest: DataFrame, rule: str = "days") -> DataFrame:
    """history: ticker, day_no, revenue, ebit. latest: ticker, pretax, tax_provision, interest,
    total_debt, cash, price, shares, beta, risk_free."""
    from pyspark.sql import functions as F

    folded = history.groupBy("ticker").agg(*[F.expr(s).alias(n) for n, s in HISTORY.items()])
    return apply(folded.join(latest, "ticker"), dcf_stages(rule))


def second_cells(valued: DataFrame, tables=(1, 2, 3, 4, 5)) -> DataFrame:
    from pyspark.sql import functions as F

    from tidemark.operators.sensitivity import scenarios
    from tidemark.params import SensitivityGrids

    names = ("table_no", "pos", "s_wacc", "s_terminal", "s_growth", "s_margin")
    grid = F.array(*[
        F.struct(*[F.lit(v).cast("int" if i < 2 else "double").alias(names[i])
                   for i, v in enumerate(row)])
        for row in scenarios(SensitivityGrids(), tables)
    ])
    return apply(valued.filter("wacc is not null").select("*", F.inline(grid)), cell_stages())
