"""Line items, period facts and the ratios derived from them.

A company's statements are folded to one row per (ticker, statement, period) with
map-side combine, so a ticker holding a large share of the input costs no more than
its distinct periods after the first shuffle. Everything later works on those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import first_reason, nan_to_null, nonzero, ratio
from tidemark.functions.valuation import cost_of_debt, effective_tax_rate, revenue_cagr
from tidemark.params import DcfParams

# Statement, then accepted labels in priority order.
LINE_ITEMS = {
    "revenue": ("income", ["Total Revenue", "TotalRevenue"]),
    "revenue_strict": ("income", ["Total Revenue"]),
    "ebit": ("income", ["EBIT", "Ebit", "Operating Income", "OperatingIncome"]),
    "ebit_strict": ("income", ["EBIT", "Operating Income"]),
    "pretax": ("income", ["Pretax Income", "PretaxIncome"]),
    "tax_provision": ("income", ["Tax Provision", "TaxProvision", "Income Tax Expense"]),
    "interest": (
        "income",
        ["Interest Expense", "InterestExpense", "Interest Expense Non Operating"],
    ),
    "net_income": ("income", ["Net Income", "NetIncome", "Net Income Common Stockholders"]),
    "gross_profit": ("income", ["Gross Profit"]),
    "cost_of_revenue": ("income", ["Cost Of Revenue", "Reconciled Cost Of Revenue"]),
    "total_debt": ("balance", ["Total Debt", "TotalDebt"]),
    "cash": (
        "balance",
        [
            "Cash And Cash Equivalents",
            "CashAndCashEquivalents",
            "Cash Cash Equivalents And Short Term Investments",
        ],
    ),
    "equity": (
        "balance",
        [
            "Stockholders Equity",
            "Common Stock Equity",
            "Total Stockholder Equity",
            "Total Equity Gross Minority Interest",
        ],
    ),
    "total_assets": ("balance", ["Total Assets"]),
    "current_assets": ("balance", ["Current Assets"]),
    "current_liabilities": ("balance", ["Current Liabilities"]),
    "long_term_debt": ("balance", ["Long Term Debt", "LongTermDebt"]),
    "retained_earnings": ("balance", ["Retained Earnings"]),
    "total_liabilities": (
        "balance",
        ["Total Liabilities Net Minority Interest", "Total Liab"],
    ),
    "shares_issued": (
        "balance",
        ["Share Issued", "Ordinary Shares Number", "Common Stock Shares Outstanding"],
    ),
    "fcf_direct": ("cash_flow", ["Free Cash Flow", "FreeCashFlow"]),
    "ocf": (
        "cash_flow",
        [
            "Operating Cash Flow",
            "Cash Flow From Continuing Operating Activities",
            "Total Cash From Operating Activities",
        ],
    ),
    "capex": ("cash_flow", ["Capital Expenditure", "CapitalExpenditure", "Purchase Of PPE"]),
}

VALUATION_ITEMS = (
    "revenue", "ebit", "pretax", "tax_provision", "interest", "total_debt", "cash", "equity",
    "fcf_direct", "ocf", "capex",
)
QUALITY_ITEMS = (
    "revenue", "revenue_strict", "ebit_strict", "net_income", "gross_profit", "cost_of_revenue",
    "total_assets", "current_assets", "current_liabilities", "long_term_debt",
    "retained_earnings", "total_liabilities", "shares_issued", "ocf",
)


LABELS = {label: f"label_{n}" for n, label in enumerate(sorted({x for _, labels in LINE_ITEMS.values() for x in labels}))}


def fold_periods(statements: DataFrame, items=tuple(LINE_ITEMS)) -> DataFrame:
    """One row per (ticker, statement, period_end) with the value of each label of the items. Landed,
    it serves everything that reads statements by period in place of the statements themselves."""
    value = nan_to_null("value")
    labels = sorted({label for i in items for label in LINE_ITEMS[i][1]})
    return statements.groupBy("ticker", "statement", "period_end").agg(
        *[F.max(F.when(F.col("line_item") == label, value)).alias(LABELS[label]) for label in labels],
        F.max(F.col("line_item") == "Total Revenue").alias("has_primary_revenue"),
        F.max(F.col("line_item") == "TotalRevenue").alias("has_other_revenue"),
    )


def statement_periods(statements: DataFrame, items=VALUATION_ITEMS) -> DataFrame:
    """One row per (ticker, statement, period_end) with a column per requested item, from statement
    rows or from fold_periods.

    A period exists as soon as any row carries it, so rows are not filtered by label.
    """
    seen = LABELS
    folded = fold_periods(statements, items) if "line_item" in statements.columns else statements
    cols = [
        F.when(
            F.col("statement") == LINE_ITEMS[i][0],
            F.coalesce(*[F.col(seen[label]) for label in LINE_ITEMS[i][1]]),
        ).alias(i)
        for i in items
    ]
    extra = []
    if "revenue" in items:
        extra = [
            F.col(seen["Total Revenue"]).alias("revenue_primary"),
            F.col(seen["TotalRevenue"]).alias("revenue_other"),
            "has_primary_revenue",
            "has_other_revenue",
        ]
    out = folded.select("ticker", "statement", "period_end", *cols, *extra)
    if "fcf_direct" in items:
        out = out.withColumn("fcf", F.coalesce("fcf_direct", F.col("ocf") + F.col("capex")))
    return out


def line_item_latest(statements: DataFrame, item: str) -> DataFrame:
    """Value of one item at the newest period of its statement; an empty cell stays null."""
    statement = LINE_ITEMS[item][0]
    own = statements.filter(F.col("statement") == statement)
    per = statement_periods(own, (item,))
    return per.groupBy("ticker").agg(
        F.max("period_end").alias("period_end"), F.max_by(item, "period_end").alias("value")
    )


def periods_on_or_before(statements: DataFrame, as_of_dates, lag_days: int) -> DataFrame:
    """Statement rows visible at each date, given the filing lag."""
    dates = F.array(*[F.lit(d).cast("date") for d in as_of_dates])
    visible = F.filter(dates, lambda d: F.col("period_end") <= F.date_sub(d, lag_days))
    return statements.withColumn("as_of", F.explode(visible))


def cagr_series(periods: DataFrame) -> DataFrame:
    """Growth uses the first revenue label present anywhere in the statement, no fall-through."""
    w = Window.partitionBy("ticker", "statement")
    has = F.max("has_primary_revenue").over(w)
    return periods.withColumn(
        "cagr_revenue",
        F.when(has, F.col("revenue_primary")).otherwise(F.col("revenue_other")),
    )


def with_prior(periods: DataFrame, items) -> DataFrame:
    """Add prior_<item>: the value one period earlier in the same statement."""
    w = Window.partitionBy("ticker", "statement").orderBy("period_end")
    return periods.withColumns(
        {
            "prior_period": F.lag("period_end").over(w),
            **{f"prior_{i}": F.lag(i).over(w) for i in items},
        }
    )


def _statement_of(item: str) -> str:
    base = item.removeprefix("prior_")
    return "cash_flow" if base == "fcf" else LINE_ITEMS[base][0]


def latest_at(periods: DataFrame, cuts, items) -> DataFrame:
    """Newest visible value of every item per (ticker, as_of).

    cuts is a list of (as_of, cutoff) dates. Scalars only are aggregated, so the plan is a
    hash aggregate with map-side combine.
    """
    arr = F.array(*[
        F.struct(F.lit(a).cast("date").alias("as_of"), F.lit(c).cast("date").alias("cutoff"))
        for a, c in cuts
    ])
    rows = periods.withColumn(
        "cut", F.explode(F.filter(arr, lambda x: F.col("period_end") <= x["cutoff"]))
    ).withColumn("as_of", F.col("cut.as_of"))

    def when_st(st):
        return F.when(F.col("statement") == st, F.col("period_end"))

    aggs = [F.max_by(i, when_st(_statement_of(i))).alias(i) for i in items]
    for st in ("income", "balance", "cash_flow"):
        aggs.append(F.max(when_st(st)).alias(f"{st}_period"))
        if "prior_period" in periods.columns:
            aggs.append(F.max_by("prior_period", when_st(st)).alias(f"{st}_prior_period"))
    if "cagr_revenue" in periods.columns:
        dated = F.when(
            (F.col("statement") == "income") & F.col("cagr_revenue").isNotNull(),
            F.col("period_end"),
        )
        margin = F.when(F.col("revenue") > 0, ratio("ebit", "revenue"))
        aggs += [
            F.min_by("cagr_revenue", dated).alias("first_revenue"),
            F.max_by("cagr_revenue", dated).alias("last_revenue"),
            F.min(dated).alias("first_revenue_date"),
            F.max(dated).alias("last_revenue_date"),
            F.avg(F.when(F.col("statement") == "income", margin)).alias("avg_margin"),
        ]
    return rows.groupBy("ticker", "as_of").agg(*aggs)


def valuation_inputs(statements: DataFrame, cuts, p: DcfParams = DcfParams()) -> DataFrame:
    """Everything the valuation needs from the statements, per (ticker, as_of)."""
    periods = with_prior(cagr_series(statement_periods(statements)), ("fcf",))
    items = (*VALUATION_ITEMS[:8], "ocf", "capex", "fcf", "prior_fcf")
    facts = latest_at(periods, cuts, items)
    cagr = revenue_cagr("first_revenue", "last_revenue", "first_revenue_date", "last_revenue_date")
    growth = F.when(cagr.isNotNull(), F.least(cagr, F.lit(p.max_growth)))
    return facts.select(
        "ticker", "as_of", "income_period", "balance_period", "cash_flow_period",
        "revenue", "ebit", "pretax", "tax_provision", "interest", "total_debt", "cash", "equity",
        "ocf", "capex",
        cagr.alias("revenue_cagr"),
        growth.alias("growth_hist"),
        F.col("avg_margin").alias("margin_hist"),
        effective_tax_rate("pretax", "tax_provision").alias("tax_derived"),
        cost_of_debt("interest", "total_debt").alias("debt_cost"),
        F.when(F.col("prior_fcf") > 0, ratio("fcf", "prior_fcf") - 1).alias("fcf_growth"),
    )


def quality_facts(statements: DataFrame, cuts) -> DataFrame:
    """Current and prior values for the distress and quality scores.

    With a single period the prior column repeats the current one: strict improvements
    fail, the non-strict dilution test passes.
    """
    prior = (
        "revenue", "gross_profit", "cost_of_revenue", "total_assets", "current_assets",
        "current_liabilities", "long_term_debt", "shares_issued", "net_income",
    )
    periods = with_prior(statement_periods(statements, QUALITY_ITEMS), prior)
    facts = latest_at(periods, cuts, (*QUALITY_ITEMS, *[f"prior_{i}" for i in prior]))
    fill = {
        f"prior_{i}": F.when(
            F.col(f"{LINE_ITEMS[i][0]}_prior_period").isNull(), F.col(i)
        ).otherwise(F.col(f"prior_{i}"))
        for i in prior
    }
    return facts.withColumns(fill)


def f_score_factors() -> dict:
    """The nine binary tests; a test with a missing input is not met."""

    def roa(p):
        return ratio(f"{p}net_income", nonzero(f"{p}total_assets"))

    def leverage(p):
        return ratio(F.coalesce(f"{p}long_term_debt", F.lit(0.0)), nonzero(f"{p}total_assets"))

    def liquidity(p):
        return ratio(f"{p}current_assets", nonzero(f"{p}current_liabilities"))

    def gross_margin(p):
        gross = F.coalesce(
            f"{p}gross_profit", F.col(f"{p}revenue") - F.col(f"{p}cost_of_revenue")
        )
        return ratio(gross, nonzero(f"{p}revenue"))

    def turnover(p):
        return ratio(f"{p}revenue", nonzero(f"{p}total_assets"))

    return {
        "profitable": roa("") > 0,
        "cash_positive": F.col("ocf") > 0,
        "cash_above_income": F.col("ocf") > F.col("net_income"),
        "return_up": roa("") > roa("prior_"),
        "leverage_down": leverage("") < leverage("prior_"),
        "liquidity_up": liquidity("") > liquidity("prior_"),
        "no_dilution": F.col("shares_issued") <= F.col("prior_shares_issued"),
        "margin_up": gross_margin("") > gross_margin("prior_"),
        "turnover_up": turnover("") > turnover("prior_"),
    }


def f_score() -> Column:
    total = F.lit(0)
    for met in f_score_factors().values():
        total = total + F.when(met, 1).otherwise(0)
    return total


def altman_z(price="quote", shares="shares_now"):
    """Five weighted ratios (fixed weights); null as soon as an input is missing or a base is 0."""
    assets, liabilities = nonzero("total_assets"), nonzero("total_liabilities")
    return (
        1.2 * ratio(F.col("current_assets") - F.col("current_liabilities"), assets)
        + 1.4 * ratio("retained_earnings", assets)
        + 3.3 * ratio("ebit_strict", assets)
        + 0.6 * ratio(F.col(shares) * F.col(price), liabilities)
        + 1.0 * ratio("revenue_strict", assets)
    )


def capital_input_error():
    """First capital input that is present but not finite or negative."""
    from tidemark.functions.numeric import is_finite

    fields = ("price", "shares", "total_debt", "cash")
    return first_reason(*[
        (F.col(f).isNotNull() & (~is_finite(f) | (F.col(f) < 0)), f"invalid_{f}") for f in fields
    ])
