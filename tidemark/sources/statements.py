"""Reading and reshaping annual statements and company records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import schemas
from tidemark.functions.numeric import first_usable, nan_to_null
from tidemark.operators.fundamentals import VALUATION_ITEMS, latest_at, statement_periods


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                  **options) -> DataFrame:
    """A source that is not there yields no rows rather than an error."""
    try:
        return spark.read.schema(schema).options(**options).format(fmt).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def to_long(wide: DataFrame) -> DataFrame:
    """Statements with one column per period end become one row per cell, nulls kept."""
    ids = ["ticker", "statement", "line_item"]
    periods = [c for c in wide.columns if c not in ids]
    wide = wide.select(*ids, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in periods])
    return wide.unpivot(ids, periods, "period_end", "value").select(
        *ids, F.to_date("period_end").alias("period_end"), nan_to_null("value").alias("value")
    )


def read_wide_statements(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    try:
        wide = spark.read.format(fmt).options(header=True).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schemas.STATEMENTS)
    return to_long(wide)


def normalise_tickers(df: DataFrame, column: str = "ticker") -> DataFrame:
    clean = F.upper(F.trim(F.col(column)))
    return df.filter(F.length(F.trim(F.col(column))) > 0).withColumn(column, clean)


def sector_or_unknown(column="sector"):
    return F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("Unknown"))


def current_quotes(companies: DataFrame) -> DataFrame:
    """Price, share count, beta and sector with their fallbacks; zero counts as missing."""
    return companies.select(
        "ticker",
        first_usable("last_price", "alt_price").alias("current_price"),
        first_usable("shares_outstanding").alias("shares_outstanding"),
        nan_to_null("beta").alias("beta"),
        sector_or_unknown().alias("sector"),
    )


def company_records(companies: DataFrame, statements: DataFrame, as_of) -> DataFrame:
    """Market fields joined to the newest value of every valuation line item."""
    items = [i for i in VALUATION_ITEMS if i != "fcf_direct"]
    facts = latest_at(statement_periods(statements, items), [(as_of, as_of)], items)
    return current_quotes(companies).join(facts.drop("as_of"), "ticker", "left")


def padded_ids(df: DataFrame, ticker="ticker", number="cik") -> DataFrame:
    """Upper-case ticker and ten-digit registrant number."""
    return df.select(
        F.upper(F.col(ticker)).alias("ticker"),
        F.lpad(F.col(number).cast("string"), 10, "0").alias("cik"),
    )


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive schema change: missing columns read as null on either side."""
    return old.unionByName(new, allowMissingColumns=True)
