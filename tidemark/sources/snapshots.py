"""Frozen company documents: tolerant parsing, checks and reshaping to statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark import schemas
from tidemark.functions.numeric import first_reason, is_finite


def parse(raw: DataFrame) -> DataFrame:
    """Typed document next to its file's ticker; a broken document parses to nulls, tagged."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    doc = F.from_json("doc", f"{schemas.SNAPSHOT}, corrupt string", options)
    return raw.select("file_ticker", doc.alias("s")).select(
        "file_ticker", "s.*", F.col("s.corrupt").isNotNull().alias("malformed")
    ).drop("corrupt")


def load_status(docs: DataFrame) -> DataFrame:
    status = first_reason(
        (F.col("malformed") | F.col("ticker").isNull(), "malformed"),
        (F.col("ticker") != F.col("file_ticker"), "ticker_mismatch"),
    )
    return docs.select("file_ticker", "ticker", F.coalesce(status, F.lit("ok")).alias("status"))


def schema_problem():
    """First violated requirement, in document order."""

    def empty(c):
        return F.col(c).isNull() | (F.length(F.trim(F.col(c))) == 0)

    facts = ("pretax_income_usd", "tax_provision_usd", "interest_expense_usd", "total_debt_usd",
             "cash_and_equivalents_usd")
    market = ("current_price_usd_per_share", "shares_outstanding", "beta_levered_equity")
    checks = [(F.col("malformed"), "malformed")]
    checks += [(empty(c), f"{c}_empty") for c in (
        "ticker", "entity_name", "cik", "latest_complete_fiscal_year_end")]
    checks.append((F.coalesce(F.size("historical_annual_data"), F.lit(0)) <= 0, "history_empty"))
    checks += [(~is_finite(f"latest_year_facts.{c}"), f"{c}_invalid") for c in facts]
    checks.append((empty("latest_year_facts.pretax_income_accession"),
                   "pretax_income_accession_empty"))
    checks += [(~is_finite(f"market_data.{c}"), f"{c}_invalid") for c in market]
    checks += [(empty(f"market_data.{c}"), f"{c}_empty") for c in ("sector_gics", "retrieved_at_utc")]
    return first_reason(*checks)


def check_schema(docs: DataFrame) -> DataFrame:
    return docs.select("file_ticker", F.coalesce(schema_problem(), F.lit("ok")).alias("problem"))


def has_latest_year():
    return F.exists(
        "historical_annual_data",
        lambda h: h["fiscal_period_end"] == F.col("latest_complete_fiscal_year_end"),
    )


def to_statements(docs: DataFrame) -> DataFrame:
    """Statement rows; pretax, tax and interest exist on the newest year only.

    Documents whose newest year is missing from their own history give no rows; see
    check_adapter for their report.
    """
    usable = docs.filter(~F.col("malformed") & has_latest_year())
    h, latest = F.col("h"), F.col("latest_year_facts")
    newest = h["fiscal_period_end"] == F.col("latest_complete_fiscal_year_end")

    def row(statement, label, value, only_latest=False):
        v = F.when(newest, value) if only_latest else value
        return F.struct(F.lit(statement).alias("statement"), F.lit(label).alias("line_item"),
                        v.alias("value"))

    income = F.array(
        row("income", "Total Revenue", h["revenue_raw_usd"]),
        row("income", "EBIT", h["ebit_raw_usd"]),
        row("income", "Pretax Income", latest["pretax_income_usd"], True),
        row("income", "Tax Provision", latest["tax_provision_usd"], True),
        row("income", "Interest Expense", latest["interest_expense_usd"], True),
    )
    balance = F.array(
        row("balance", "Total Debt", latest["total_debt_usd"]),
        row("balance", "Cash And Cash Equivalents", latest["cash_and_equivalents_usd"]),
    )
    rows = F.when(newest, F.concat(income, balance)).otherwise(income)
    return (
        usable.withColumn("h", F.explode("historical_annual_data"))
        .select("ticker", F.to_date(h["fiscal_period_end"]).alias("period_end"), F.inline(rows))
        .select("ticker", "statement", "line_item", "period_end", "value")
    )


def adapter_mismatches(docs: DataFrame, statements: DataFrame) -> DataFrame:
    """Source values that the reshaped statements do not carry exactly, both directions."""
    melted = docs.filter(~F.col("malformed") & has_latest_year()).select(
        "ticker", F.inline("historical_annual_data")
    )
    period = F.to_date("fiscal_period_end").alias("period_end")
    source = melted.select(
        "ticker", period, F.lit("Total Revenue").alias("line_item"),
        F.col("revenue_raw_usd").alias("value"),
    ).unionByName(melted.select(
        "ticker", period, F.lit("EBIT").alias("line_item"), F.col("ebit_raw_usd").alias("value"),
    ))
    got = statements.filter(F.col("line_item").isin("Total Revenue", "EBIT")).select(
        "ticker", "period_end", "line_item", "value"
    )
    lost = source.exceptAll(got).withColumn("side", F.lit("lost"))
    return lost.unionByName(got.exceptAll(source).withColumn("side", F.lit("altered")))


def company_rows(docs: DataFrame) -> DataFrame:
    m = F.col("market_data")
    return docs.filter(~F.col("malformed")).select(
        "ticker", m["current_price_usd_per_share"].alias("price"),
        m["shares_outstanding"].alias("shares"), m["beta_levered_equity"].alias("beta"),
        m["sector_gics"].alias("sector"),
    )
