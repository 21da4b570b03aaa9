"""Pieces shared by several registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark import fixtures as fx
from tidemark.operators import valuation
from tidemark.operators.fundamentals import fold_periods
from tidemark.params import DcfParams
from tidemark.session import land


def market_rows(t, dates=fx.AS_OF, statements=None) -> DataFrame:
    return valuation.market_rows(
        t.companies, t.statements if statements is None else statements, t.company_prices, t.shares, t.splits, dates,
        macro=t.macro_prices,
    )


def landed_valuations(t, dates=fx.AS_OF, p: DcfParams = DcfParams(), statements=None) -> DataFrame:
    """First pass, written once because medians and scoring both read it. The folded statements are
    a table of their own, so that the fold and the valuation are planned and compiled apart."""
    if statements is None:
        statements = land(fold_periods(t.statements), "periods")
    return land(valuation.valuations(market_rows(t, dates, statements), p), "valuations")
