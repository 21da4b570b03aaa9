"""Regulatory facts, provenance and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import facts as fa, manifest as mf
from tidemark.plans.registry import query
from tidemark.session import land
from tidemark.sources import integrity, snapshots as sn


def scanned(t):
    """Parsed facts, landed because every later step reads them."""
    return land(fa.scan_facts(t.xbrl_facts_raw), "facts")


@query(money=("val",))
def l8_fact_filter(t):
    return fa.annual_facts(fa.scan_facts(t.xbrl_facts_raw)).select(
        "ticker", "tag", "start", "end", "val", "accn", "filed"
    )


@query(money=("val",))
def w13_first_filed(t):
    firsts = fa.first_filed(fa.annual_facts(fa.scan_facts(t.xbrl_facts_raw)))
    return firsts.select("ticker", "tag", "end", "val", "accn", "filed")


@query(money=("val",))
def u3_tag_merge(t):
    firsts = fa.first_filed(fa.annual_facts(fa.scan_facts(t.xbrl_facts_raw)))
    return fa.merge_tags(firsts, fa.FIELD_TAGS["revenue"], "revenue").select(
        "ticker", "end", "tag", "val", "accn"
    )


@query()
def j6_tag_intersection(t):
    return fa.latest_complete_year(fa.merged_fields(fa.scan_facts(t.xbrl_facts_raw)))


@query(money=("revenue", "ebit"))
def w17_last_five_years(t):
    years = fa.history_years(fa.merged_fields(fa.scan_facts(t.xbrl_facts_raw)))
    return years.select("ticker", "end", "revenue", "ebit", "revenue_tag", "years_back")


def sheets(t):
    return fa.company_sheets(scanned(t))


@query(money=("total_debt",))
def a16_debt_rollup(t):
    return fa.debt_rollup(sheets(t)[2])


@query(money=("revenue", "pretax", "tax", "interest", "cash", "total_debt"))
def l9_company_extraction(t):
    return fa.extract_companies(sheets(t)).select(
        "ticker", "latest_end", "revenue", "pretax", "tax", "interest", "revenue_accn", "cash",
        "total_debt", "method", "component_tags", "history_years", "first_year",
    )


def own_lists(t):
    """Every sixth company has interest as cash paid, every tenth leaves the current total out."""
    k = F.col("universe_pos")

    def rows(test, field, tags, method):
        listed = F.array(*[F.struct(F.lit(tag).alias("tag"), F.lit(i).alias("priority")) for i, tag in enumerate(tags)])
        return t.companies.filter(test).select(
            "ticker", F.lit(field).alias("field"), F.inline(listed), F.lit(method).alias("method"))

    return rows(k % 6 == 0, "interest", ("InterestPaidNet",), "proxy_cash_paid_interest").unionByName(
        rows(k % 10 == 1, "debt_component", fa.DEBT_COMPONENTS[:2], "reported"))


def planted_sheets(t):
    """Facts with paid interest beside every third company's expense, and with the total of current
    debt beside its parts at companies that end in 1, 2, 6 or 7; read by the companies' own lists."""
    f = scanned(t)
    k, tag = F.substring("ticker", 2, 5).cast("int"), F.col("tag")

    def also(test, name, scale):
        return f.filter(test).withColumns({"tag": F.lit(name), "val": F.col("val") * scale})

    paid = also((k % 3 == 0) & tag.isin(*fa.FIELD_TAGS["interest"]), "InterestPaidNet", 0.9)
    current = also((k % 5).isin(1, 2) & (tag == "LongTermDebtCurrent"), "DebtCurrent", 1.5)
    return fa.company_sheets(f.unionByName(paid).unionByName(current), own_lists(t))


@query(money=("interest", "total_debt"))
def l9_own_tag_lists(t):
    return fa.extract_companies(planted_sheets(t)).select(
        "ticker", "latest_end", "interest", "interest_method", "total_debt", "method", "component_tags")


@query(money=("val",))
def a16_debt_components(t):
    """Each component behind a debt figure, with its filing and whether it was added."""
    return fa.debt_components(planted_sheets(t)[2]).select(
        "ticker", "latest_end", "tag", "val", "accn", "filed", "source_url", "covered_by", "use")


@query()
def x24_filing_urls(t):
    return fa.scan_facts(t.xbrl_facts_raw).select("cik", "accn").distinct().select(
        "accn", fa.filing_url("cik", "accn").alias("url")
    )


def market_side(t):
    return t.companies.select(
        "ticker", F.col("alt_price").alias("price"), F.col("shares_outstanding").alias("shares"),
        "beta", "sector", F.lit("2001-06-30T00:00:00Z").alias("retrieved_at"),
    )


@query(money=("raw_value",))
def u4_provenance_rows(t):
    return mf.build(sheets(t), market_side(t))


def damaged_manifest(t, facts):
    """The manifest of company sheets with one kind of damage per ticker group."""
    rows = mf.build(facts, market_side(t))
    k = F.substring("ticker", 2, 5).cast("int") % 12
    field = F.col("field")
    out = rows.filter(~((k == 1) & (field == "Tax Provision (latest)")))
    out = out.withColumn("raw_value", F.when((k == 3) & (field == mf.DERIVED), F.col("raw_value") * 2)
                         .otherwise(F.col("raw_value")))
    out = out.withColumn("accession", F.when(
        (k == 4) & F.startswith("field", F.lit(mf.COMPONENT)), F.lit("")
    ).when((k == 5) & (field == mf.DERIVED), F.concat("accession", F.lit("; "), "accession"))
        .when((k == 6) & (field == "Revenue"), F.lit(None)).otherwise(F.col("accession")))
    out = out.withColumn("period", F.when((k == 7) & (field == "Beta"), F.lit("")).otherwise(
        F.col("period")))
    out = out.withColumn("provenance", F.when((k == 8) & (field == mf.DERIVED), F.lit("reported"))
                         .otherwise(F.col("provenance")))
    return out.unionByName(out.filter((k == 2) & (field == "Beta")))


@query()
def l10_manifest_completeness(t):
    return mf.completeness_problems(damaged_manifest(t, sheets(t)))


@query()
def l11_manifest_structure(t):
    facts = sheets(t)
    expected = fa.extract_companies(facts).select("ticker", "history_years", "pretax", "tax", "cash")
    return mf.structure_problems(land(damaged_manifest(t, facts), "manifest"), expected)


@query()
def u2_manifest_differences(t):
    """Entries every company should have against those present in the damaged manifest."""
    names = F.array(*[F.lit(n) for n in (*mf.LATEST_FIELDS.values(), mf.CASH, *mf.MARKET_FIELDS)])
    facts = sheets(t)
    companies = facts[1].select("ticker")
    wanted = companies.select("ticker", F.explode(names).alias("field"))
    present = damaged_manifest(t, facts).filter(F.array_contains(names, F.col("field"))).select(
        "ticker", "field")
    return integrity.set_difference(wanted, present)


@query()
def l12_snapshot_schema(t):
    return sn.check_schema(sn.parse(t.snapshots_raw))


@query(money=("value",))
def l13_adapter_check(t):
    """Some reshaped values are altered on purpose."""
    docs = sn.parse(t.snapshots_raw)
    got = sn.to_statements(docs).withColumn("value", F.when(
        F.endswith("ticker", F.lit("5")), F.col("value") + 1).otherwise(F.col("value")))
    return sn.adapter_mismatches(docs, got)
