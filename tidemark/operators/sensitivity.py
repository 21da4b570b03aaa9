"""Scenario tables. All five grids of a company come from one exploded literal array."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import valuation as V
from tidemark.functions.numeric import ratio
from tidemark.params import DcfParams, SensitivityGrids

OUTPUTS = {
    1: ("terminal_value", "enterprise_value", "equity_value", "intrinsic_value"),
    2: ("terminal_value", "enterprise_value", "equity_value", "intrinsic_value"),
    3: ("fcf_1", "fcf_2", "fcf_3", "fcf_4", "fcf_5", "terminal_value", "enterprise_value",
        "equity_value", "intrinsic_value"),
    4: ("fcf_1", "fcf_2", "fcf_3", "fcf_4", "fcf_5", "terminal_value", "enterprise_value",
        "equity_value", "intrinsic_value"),
    5: ("intrinsic_value",),
}


def scenarios(grids: SensitivityGrids, tables=(1, 2, 3, 4, 5)):
    """(table, position, wacc, terminal growth, growth, margin); null keeps the base value."""
    rows = []
    single = {1: ("wacc", 2), 2: ("terminal_growth", 3), 3: ("growth", 4), 4: ("margin", 5)}
    for table, (axis, slot) in single.items():
        for pos, v in enumerate(getattr(grids, axis)):
            row = [table, pos, None, None, None, None]
            row[slot] = v
            rows.append(tuple(row))
    n = len(grids.two_way_growth)
    for i, w in enumerate(grids.two_way_wacc):
        for j, g in enumerate(grids.two_way_growth):
            rows.append((5, i * n + j, w, g, None, None))
    return [r for r in rows if r[0] in tables]


def sensitivity(valued: DataFrame, p: DcfParams = DcfParams(),
                grids: SensitivityGrids = SensitivityGrids(), tables=(1, 2, 3, 4, 5)) -> DataFrame:
    """One row per company, table and scenario; values are null where wacc <= growth."""
    names = ("table_no", "pos", "s_wacc", "s_terminal", "s_growth", "s_margin")

    def scenario(row):
        return F.struct(*[
            F.lit(v).cast("int" if i < 2 else "double").alias(names[i]) for i, v in enumerate(row)
        ])

    grid = F.array(*[scenario(r) for r in scenarios(grids, tables)])
    rows = valued.filter("revenue > 0 and wacc is not null").select("*", F.inline(grid))
    rows = rows.withColumns({
        "x_wacc": F.coalesce("s_wacc", "wacc"),
        "x_terminal": F.coalesce("s_terminal", "terminal_growth"),
        "x_growth": F.coalesce("s_growth", "growth"),
        "x_margin": F.coalesce("s_margin", "margin"),
    })
    flows = {
        f"fcf_{y}": V.fcf_in("revenue", "x_growth", "x_margin", "tax_rate", F.lit(float(y)), p)
        for y in range(1, p.years + 1)
    }
    rows = rows.withColumns(flows)
    rows = rows.withColumn(
        "terminal_value", V.terminal_value(f"fcf_{p.years}", "x_wacc", "x_terminal")
    )
    explicit = F.lit(0.0)
    for y in range(1, p.years + 1):
        explicit = explicit + F.col(f"fcf_{y}") / F.pow(1 + F.col("x_wacc"), F.lit(float(y)))
    ev = explicit + F.col("terminal_value") / F.pow(1 + F.col("x_wacc"), F.lit(float(p.years)))
    rows = rows.withColumn("enterprise_value", ev)
    rows = rows.withColumn(
        "equity_value",
        F.col("enterprise_value") - F.coalesce("total_debt", F.lit(0.0))
        + F.coalesce("cash", F.lit(0.0)),
    )
    return rows.select(
        "ticker", "as_of", "table_no", "pos", "x_wacc", "x_terminal", "x_growth", "x_margin",
        *flows, "terminal_value", "enterprise_value", "equity_value",
        ratio("equity_value", "shares").alias("intrinsic_value"),
    )


def melt(cells: DataFrame) -> DataFrame:
    """One row per scalar that belongs to its table (227 per company)."""
    outputs = sorted({o for outs in OUTPUTS.values() for o in outs})
    pairs = F.array(*[
        F.struct(F.lit(o).alias("output"), F.col(o).alias("value"),
                 F.col("table_no").isin(*[t for t, outs in OUTPUTS.items() if o in outs])
                 .alias("wanted"))
        for o in outputs
    ])
    return cells.select("ticker", "as_of", "table_no", "pos", F.inline(pairs)).filter("wanted").drop(
        "wanted"
    )


def recovered_tax(flows: DataFrame) -> DataFrame:
    """Tax rate implied by the first projected year, next to the rate that was used."""
    first = flows.filter("year = 1")
    return first.select(
        "ticker", "as_of", "tax_rate",
        (1 - ratio("nopat", "projected_ebit")).alias("implied_tax_rate"),
    )


def risk_density(rows: DataFrame, bins: int = 61, width: float = 4.0) -> DataFrame:
    """Illustrative normal density whose 5th percentile is the given VaR."""
    from tidemark.functions.normal import normal_density

    # Fixed value: 5th-percentile z-score.
    sigma = F.abs("var_95") / 1.6448536269514722
    edge = F.col("sigma") * width
    grid = rows.withColumn("sigma", sigma).filter("sigma > 0").withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    )
    x = -edge + F.col("bin") * (2 * edge / (bins - 1))
    return grid.withColumn("x", x).withColumn(
        "density", normal_density(F.col("x"), F.col("sigma"))
    )
