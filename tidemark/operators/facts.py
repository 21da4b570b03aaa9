"""Regulatory fact extraction: scan, filter, first filing, tag priority and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import schemas
from tidemark.session import land

# Field -> tags in priority order.
FIELD_TAGS = {
    "revenue": (
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "Revenues",
        "SalesRevenueNet",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
    ),
    "ebit": ("OperatingIncomeLoss",),
    "pretax": (
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItems"
        "NoncontrollingInterest",
        "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLoss"
        "FromEquityMethodInvestments",
    ),
    "tax": ("IncomeTaxExpenseBenefit",),
    "interest": ("InterestExpense", "InterestExpenseNonoperating"),
    "cash": ("CashAndCashEquivalentsAtCarryingValue",),
    "debt_combined": ("DebtLongtermAndShorttermCombinedAmount",),
}
DEBT_COMPONENTS = ("LongTermDebtNoncurrent", "LongTermDebtCurrent", "ShortTermBorrowings", "DebtCurrent")
# Reported total -> its parts, which are not added to it.
TOTALS = {"DebtCurrent": ("LongTermDebtCurrent", "ShortTermBorrowings")}
TAG_MAP = "ticker string, field string, tag string, priority int, method string"


def scan_facts(raw: DataFrame) -> DataFrame:
    """Nested JSON to one row per reported dollar fact, with its position in the document."""
    parsed = raw.select(
        "ticker", "cik", F.explode(F.from_json("facts", schemas.XBRL_FACTS)).alias("tag", "body")
    )
    return parsed.select(
        "ticker", "cik", "tag", F.posexplode(F.col("body.units")["USD"]).alias("pos", "f")
    ).select("ticker", "cik", "tag", "pos", "f.*")


def annual_facts(facts: DataFrame) -> DataFrame:
    """Annual-report rows covering about a year, or a single instant."""
    days = F.datediff("end", "start")
    return facts.filter(
        (F.col("form") == "10-K") & (F.col("start").isNull() | days.between(330, 400))
    )


def first_filed(facts: DataFrame) -> DataFrame:
    """Earliest filing per (ticker, tag, period end); the first listed wins a tie."""
    w = Window.partitionBy("ticker", "tag", "end").orderBy("filed", "pos")
    return facts.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def _tag_rank(tags) -> Column:
    out = F.lit(None).cast("int")
    for i, tag in enumerate(tags):
        out = F.coalesce(out, F.when(F.col("tag") == tag, i))
    return out


def merge_tags(firsts: DataFrame, tags, field: str) -> DataFrame:
    """One row per (ticker, end) from the highest-priority tag that reports it."""
    w = Window.partitionBy("ticker", "end").orderBy("tag_rank")
    return (
        firsts.filter(F.col("tag").isin(*tags)).withColumn("tag_rank", _tag_rank(tags))
        .withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "tag_rank")
        .withColumn("field", F.lit(field))
    )


def mapped(facts: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Facts whose tag means a field to their company, with field, tag_rank and method.

    own (ticker, field, tag, priority, method) is a company's own list: where it names a field, its
    tags replace the usual ones for that field, so a method such as a proxy goes with the tag. A
    company lists a few tags, which travel as one array with its facts. A tag that serves two
    fields gives two rows.
    """
    usual = F.array(*[
        F.struct(F.lit(field).alias("field"), F.lit(i).alias("tag_rank"), F.lit(tag).alias("tag"),
                 F.lit("reported").alias("method"))
        for field, tags in (FIELD_TAGS | {"debt_component": DEBT_COMPONENTS}).items()
        for i, tag in enumerate(tags)
    ])
    if own is not None:
        entry = F.struct("field", F.col("priority").alias("tag_rank"), "tag", "method")
        lists = own.groupBy("ticker").agg(F.collect_set(entry).alias("own"))
        facts = facts.join(lists, "ticker", "left")
        replaced = F.coalesce(F.transform("own", lambda e: e["field"]), F.array().cast("array<string>"))
        usual = F.concat(
            F.coalesce("own", F.filter(usual, lambda e: F.lit(False))),
            F.filter(usual, lambda e: ~F.array_contains(replaced, e["field"])))
    means = F.transform(
        F.filter(usual, lambda e: e["tag"] == F.col("tag")),
        lambda e: F.struct(e["field"].alias("field"), e["tag_rank"].alias("tag_rank"), e["method"].alias("method")))
    rest = [c for c in facts.columns if c != "own"]
    return facts.select(*rest, F.inline(means))


def merged_fields(facts: DataFrame, fields=("revenue", "ebit", "pretax", "tax", "interest"),
                  own: DataFrame | None = None):
    """All duration fields at once: per period the first filing of the company's first tag."""
    w = Window.partitionBy("ticker", "field", "end").orderBy("tag_rank", "filed", "pos")
    return (
        mapped(annual_facts(facts), own).filter(F.col("field").isin(*fields))
        .withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "tag_rank")
    )


def instants(facts: DataFrame) -> DataFrame:
    """Point-in-time annual-report values; the first listed wins."""
    w = Window.partitionBy("ticker", "tag", "end").orderBy("pos")
    rows = facts.filter((F.col("form") == "10-K") & F.col("start").isNull())
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def filing_url(cik, accn) -> Column:
    base = F.lit("https://www.sec.gov/Archives/edgar/data/")
    return F.concat(
        base, F.col(cik).cast("bigint").cast("string"), F.lit("/"),
        F.replace(accn, F.lit("-"), F.lit("")), F.lit("/"), F.col(accn), F.lit("-index.htm"),
    )


def latest_complete_year(fields: DataFrame) -> DataFrame:
    """Newest period end that has revenue, pretax income and tax."""
    need = ("revenue", "pretax", "tax")
    have = fields.filter(F.col("field").isin(*need)).groupBy("ticker", "end").agg(
        F.count_distinct("field").alias("n")
    )
    return have.filter(F.col("n") == len(need)).groupBy("ticker").agg(
        F.max("end").alias("latest_end")
    )


def history_years(fields: DataFrame, n: int = 5) -> DataFrame:
    """The last n period ends with both revenue and operating income."""
    both = fields.filter(F.col("field").isin("revenue", "ebit")).groupBy("ticker", "end").agg(
        *[F.max(F.when(F.col("field") == f, F.col("val"))).alias(f) for f in ("revenue", "ebit")],
        *[F.max(F.when(F.col("field") == f, F.col("accn"))).alias(f"{f}_accn")
          for f in ("revenue", "ebit")],
        F.max(F.when(F.col("field") == "revenue", F.col("tag"))).alias("revenue_tag"),
    ).filter("revenue is not null and ebit is not null")
    w = Window.partitionBy("ticker").orderBy(F.desc("end"))
    return both.withColumn("years_back", F.row_number().over(w)).filter(F.col("years_back") <= n)


def joined_unique(rows: Column) -> Column:
    """Distinct values in first-seen order, joined for provenance."""
    ordered = F.transform(F.array_sort(rows), lambda r: r["v"])
    return F.array_join(F.array_distinct(ordered), "; ")


def newest_instants(facts: DataFrame, latest: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Point-in-time facts at each company's newest complete year, with field and tag rank."""
    at = mapped(instants(facts), own).join(latest, "ticker")
    return at.filter(F.col("end") == F.col("latest_end"))


def debt_components(at: DataFrame) -> DataFrame:
    """The components behind each debt figure, one row each, from newest_instants.

    use says how a row enters the figure: `added`; `part` of a total that is reported too and named
    in covered_by; or `combined`, where the company reports all its debt under one tag.
    """
    parts = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(total).alias("total"))
                      for total, members in TOTALS.items() for part in members])
    rows = at.filter(F.col("field").isin("debt_component", "debt_combined"))
    together = rows.groupBy("ticker").agg(
        F.collect_set(F.when(F.col("field") == "debt_component", F.col("tag"))).alias("present"),
        F.bool_or(F.col("field") == "debt_combined").alias("has_combined"))
    covers = F.filter(parts, lambda p: (p["part"] == F.col("tag")) & F.array_contains("present", p["total"]))
    rows = rows.filter("field = 'debt_component'").join(together, "ticker").withColumn(
        "covered_by", F.get(covers, F.lit(0))["total"])
    use = F.when(F.col("has_combined"), "combined").when(F.col("covered_by").isNotNull(), "part").otherwise("added")
    return rows.withColumns({"source_url": filing_url("cik", "accn"), "use": use}).drop(
        "present", "has_combined")


def debt_rollup(at: DataFrame) -> DataFrame:
    """Total debt from newest_instants: the combined tag where reported, else the components that
    are not part of another reported one."""
    added = debt_components(at).filter("use = 'added'").select(
        "ticker", "latest_end", "field", "tag_rank", "tag", "val", "accn", "filed", "cik")
    at = added.unionByName(at.filter("field = 'debt_combined'").select(added.columns))
    combined = F.col("field") == "debt_combined"
    rank = F.when(~combined, F.col("tag_rank"))
    url = filing_url("cik", "accn")

    def listed(v):
        part = F.when(rank.isNotNull(), F.struct(rank.alias("pos"), v.alias("v")))
        return F.collect_list(part)

    agg = at.groupBy("ticker").agg(
        F.max("latest_end").alias("latest_end"),
        F.max(F.when(combined, F.col("val"))).alias("combined"),
        F.max(F.when(combined, F.col("accn"))).alias("combined_accn"),
        F.sum(F.when(rank.isNotNull(), F.col("val"))).alias("summed"),
        listed(F.col("tag")).alias("tags"),
        listed(F.col("accn")).alias("accns"),
        listed(F.date_format("filed", "yyyy-MM-dd")).alias("dates"),
        listed(url).alias("urls"),
    )
    direct = F.col("combined").isNotNull()
    return agg.select(
        "ticker", "latest_end",
        F.coalesce("combined", "summed").alias("total_debt"),
        F.when(direct, "reported").otherwise("summed").alias("method"),
        F.when(direct, F.lit("")).otherwise(joined_unique(F.col("tags"))).alias("component_tags"),
        F.when(direct, F.col("combined_accn")).otherwise(joined_unique(F.col("accns")))
        .alias("accessions"),
        F.when(direct, F.lit("")).otherwise(joined_unique(F.col("dates"))).alias("filed_dates"),
        F.when(direct, F.lit("")).otherwise(joined_unique(F.col("urls"))).alias("source_urls"),
    )


def company_sheets(facts: DataFrame, own: DataFrame | None = None):
    """(fields, newest years, newest instants), landed once for everything that is derived from them."""
    fields = land(merged_fields(facts, own=own), "fields")
    latest = land(latest_complete_year(fields), "newest-years")
    return fields, latest, land(newest_instants(facts, latest, own), "newest-instants")


def extract_companies(sheets) -> DataFrame:
    """One row per company from company_sheets: newest complete year, its facts with the method
    behind interest, its debt and its history length."""
    fields, latest, at = sheets
    at_latest = fields.join(latest, "ticker").filter(F.col("end") == F.col("latest_end"))
    wide = at_latest.groupBy("ticker", "latest_end").agg(*[
        F.max(F.when(F.col("field") == f, F.col(v))).alias(f"{f}{suffix}")
        for f in ("revenue", "pretax", "tax", "interest")
        for v, suffix in (("val", ""), ("accn", "_accn"))
    ], F.max(F.when(F.col("field") == "interest", F.col("method"))).alias("interest_method"))
    first = Window.partitionBy("ticker").orderBy("tag_rank")
    cash = at.filter("field = 'cash'").withColumn("rn", F.row_number().over(first)).filter("rn = 1").select(
        "ticker", F.col("val").alias("cash"), F.col("accn").alias("cash_accn"))
    years = history_years(fields).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("history_years"), F.min("end").alias("first_year")
    )
    return (
        wide.join(cash, "ticker", "left").join(debt_rollup(at).drop("latest_end"), "ticker", "left")
        .join(years, "ticker", "left")
    )
