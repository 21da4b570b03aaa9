"""Valuation of a request table against current quotes, with the sector comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numeric import first_reason, is_finite, ratio
from tidemark.operators import asof, lookup
from tidemark.operators.fundamentals import valuation_inputs
from tidemark.operators.valuation import projection, value_companies
from tidemark.params import (
    GROWTH_BOUNDS, MARGIN_BOUNDS, TERMINAL_GROWTH_BOUNDS, DcfParams, LookupParams, ScanParams,
)
from tidemark.sources.statements import current_quotes


def assumption_problem() -> Column:
    """First explicit assumption that is not finite or lies outside its bounds; nulls are allowed."""
    def outside(c, bounds):
        return F.col(c).isNotNull() & (~is_finite(c) | ~F.col(c).between(*bounds))

    return first_reason(
        (outside("growth_request", GROWTH_BOUNDS), "growth_out_of_range"),
        (outside("margin_request", MARGIN_BOUNDS), "margin_out_of_range"),
        (outside("terminal_request", TERMINAL_GROWTH_BOUNDS), "terminal_growth_out_of_range"),
    )


def evaluate(requests: DataFrame, companies: DataFrame, statements: DataFrame, macro: DataFrame,
             snapshots: DataFrame, as_of, now, p: DcfParams = DcfParams(),
             look: LookupParams = LookupParams(), s: ScanParams = ScanParams()) -> DataFrame:
    """requests: ticker, growth_request, margin_request, terminal_request (nulls = historical, for
    the terminal growth the parameter).

    Each request gets one row, repeated ones too. dcf_error is invalid_ticker for a blank one,
    unknown_ticker, an assumption out of bounds, or why there is no value; requests refused for one
    of the first three are not compared with their sector. projection holds the projected years.
    Statements are used without a filing lag, as for a valuation made today. snapshots holds
    one parsed document.
    """
    quotes = current_quotes(companies).select(
        "ticker", F.col("current_price").alias("price"),
        F.col("shares_outstanding").alias("shares"), "beta", "sector", F.lit(True).alias("known"),
    )
    asked = requests.withColumns({
        "ticker": F.upper(F.trim("ticker")),
        "terminal_request": F.coalesce("terminal_request", F.lit(p.terminal_growth)),
    })
    inputs = valuation_inputs(statements, [(as_of, as_of)], p)
    rate = asof.risk_free(macro, [as_of], p=s)
    rows = (
        asked.join(quotes, "ticker", "left").withColumn("refused", first_reason(
            (F.coalesce(F.length("ticker"), F.lit(0)) == 0, "invalid_ticker"),
            (F.col("known").isNull(), "unknown_ticker"),
            (assumption_problem().isNotNull(), assumption_problem())))
        .join(inputs.drop("as_of"), "ticker", "left")
        .withColumn("as_of", F.lit(as_of).cast("date")).join(rate, "as_of", "left")
    )
    v = value_companies(
        rows, p, growth="growth_request", margin="margin_request",
        terminal_growth="terminal_request",
    )
    ok = F.col("dcf_error").isNull()
    v = v.withColumn("dcf_error", F.coalesce("refused", "dcf_error")).withColumn(
        "price_to_intrinsic",
        F.when(ok & (F.col("intrinsic_value") > 0) & (F.col("price") != 0),
               ratio("price", "intrinsic_value")),
    )
    stored = {c: snapshots.select(c).scalar() for c in ("snapshot", "malformed")}
    looked = lookup.lookup(v.withColumns(stored), now, look)

    def source(c):
        return F.when(F.col(c).isNull(), "historical").otherwise("custom")

    values = ("wacc", "enterprise_value", "equity_value", "intrinsic_value", "growth", "margin")
    return looked.select(
        "ticker", "sector", "price", *[F.when(ok, F.col(c)).alias(c) for c in values],
        "price_to_intrinsic",
        *[F.when(F.col("refused").isNull(), F.col(c)).alias(c) for c in ("sector_median", "unavailable_reason")],
        "dcf_error", F.when(ok, projection(p)).alias("projection"),
        source("growth_request").alias("growth_source"),
        source("margin_request").alias("margin_source"),
    )
