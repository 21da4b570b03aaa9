"""Finance tables derived from the star-schema parquet (rules in FIXTURES.md).

Facts have at most four decimals and are summed as whole ten-thousandths, so the sums are
exact and do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AS_OF = ("2000-06-30", "2001-06-30")
LAST_DAY = "2001-08-31"


_SCANS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan; the handle (not the data) is kept so the file footer is read once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SCANS:
        _SCANS[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _SCANS[key]


def _units(c: Column) -> Column:
    return F.rint(c * 10000.0).cast("bigint")


def ticker_of(k: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(k.cast("string"), 5, "0"))


def mod(k: Column, n: int) -> Column:
    return (k % n) == 0


def base_facts(spark, sf_dir) -> DataFrame:
    """One row per company key and fiscal year."""
    li = table(spark, sf_dir, "lineitem")
    ep, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")

    def total(c):
        return F.coalesce(F.sum(_units(c)), F.lit(0)) / F.lit(10000.0)

    return (
        li.filter(F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
        .groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("fy"))
        .agg(
            total(ep * (1 - disc)).alias("rev"),
            total(F.when(F.col("l_returnflag") == "R", ep)).alias("ret"),
            total(ep * tax).alias("tax"),
            total(F.col("l_quantity")).alias("q"),
            total(ep).alias("ep"),
        )
    )


def _labelled_facts(spark, sf_dir) -> DataFrame:
    k, rev, ret, tax, q, ep = (F.col(c) for c in ("k", "rev", "ret", "tax", "q", "ep"))
    core = 0.35 * rev - 0.4 * ret
    ebit = F.when(mod(k, 41), -0.05 * rev).otherwise(core)
    interest = 0.02 * ep
    pretax = ebit - interest
    liabilities = 0.4 * rev + 0.15 * ep
    revenue_label = F.when(mod(k, 19), F.lit("TotalRevenue")).otherwise(F.lit("Total Revenue"))
    ebit_label = F.when(mod(k, 17), F.lit("Operating Income")).otherwise(F.lit("EBIT"))
    rows = [
        ("income", revenue_label, rev),
        ("income", ebit_label, ebit),
        ("income", "Interest Expense", interest),
        ("income", "Pretax Income", pretax),
        ("income", "Tax Provision", tax),
        ("income", "Net Income", pretax - tax),
        ("income", "Gross Profit", 0.5 * rev - 0.2 * ret),
        ("balance", "Total Debt", 0.4 * rev),
        ("balance", "Long Term Debt", 0.3 * rev),
        ("balance", "Cash And Cash Equivalents", F.when(~mod(k, 11), 0.1 * rev)),
        ("balance", "Total Assets", 1.2 * ep),
        ("balance", "Current Assets", 0.4 * ep),
        ("balance", "Current Liabilities", 0.15 * ep + 0.3 * ret),
        ("balance", "Retained Earnings", F.when(mod(k, 9), -rev).otherwise(0.3 * rev)),
        ("balance", "Total Liabilities Net Minority Interest",
         F.when(mod(k, 9), 1.32 * ep).otherwise(liabilities)),
        ("balance", "Stockholders Equity", 1.2 * ep - liabilities),
        ("balance", "Share Issued", 1e6 + q),
        ("cash_flow", "Operating Cash Flow", 0.79 * core + 0.03 * rev),
        ("cash_flow", "Capital Expenditure", -0.05 * ep),
    ]

    def as_col(v):
        return v if isinstance(v, Column) else F.lit(v)

    entries = [
        F.struct(
            F.lit(s).alias("statement"), as_col(label).alias("line_item"), value.alias("value")
        )
        for s, label, value in rows
    ]
    facts = base_facts(spark, sf_dir)
    return facts.select(
        ticker_of(k).alias("ticker"),
        F.make_date(F.col("fy"), F.lit(12), F.lit(31)).alias("period_end"),
        F.inline(F.array(*entries)),
    )


def statements(spark, sf_dir) -> DataFrame:
    return _labelled_facts(spark, sf_dir).select(
        "ticker", "statement", "line_item", "period_end", "value"
    )


def companies(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    beta = (
        F.when(mod(k, 31), F.lit(5.0))
        .when(mod(k, 37), F.lit(-0.5))
        .when(mod(k, 29), F.lit(None).cast("double"))
        .otherwise(0.4 + 0.1 * (k % 13))
    )
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            ticker_of(k).alias("ticker"),
            F.when(~mod(k, 23), F.col("r_name")).alias("sector"),
            F.concat(F.lit("N"), F.col("s_nationkey")).alias("industry"),
            beta.alias("beta"),
            F.when(mod(k, 12), F.lit(0.0)).when(~mod(k, 15), 90.0 + (k % 40)).alias("last_price"),
            F.when(~mod(k, 60), 80.0 + (k % 50)).alias("alt_price"),
            (100000.0 + 1000.0 * (k % 7)).alias("shares_outstanding"),
            k.cast("int").alias("universe_pos"),
        )
    )


def _close(total: Column, n: Column) -> Column:
    return 100.0 * (total / F.lit(10000.0)) / n


def _daily(spark, sf_dir, keys=("k",)) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    return li.groupBy(*keys, F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum(_units((1 - F.col("l_discount")) * (1 + F.col("l_tax")))).alias("s"),
        F.sum(_units(F.col("l_discount"))).alias("sd"),
        F.sum(_units(F.col("l_tax"))).alias("st"),
        F.count(F.lit(1)).alias("n"),
    )


def company_prices(spark, sf_dir) -> DataFrame:
    return _daily(spark, sf_dir).select(
        ticker_of(F.col("k")).alias("ticker"), "date", _close(F.col("s"), F.col("n")).alias("close")
    )


def region_prices(spark, sf_dir) -> DataFrame:
    sup = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("k"), "r_name")
    )
    return (
        _daily(spark, sf_dir).join(sup, "k")
        .groupBy("r_name", "date")
        .agg(_close(F.sum("s"), F.sum("n")).alias("close"))
        .select(F.concat(F.lit("R_"), "r_name").alias("ticker"), "date", "close")
    )


def macro_prices(spark, sf_dir) -> DataFrame:
    """Index, yield and volatility series, all from one daily rollup."""
    day = _daily(spark, sf_dir, ())
    series = F.array(
        F.struct(F.lit("IDX").alias("ticker"), _close(F.col("s"), F.col("n")).alias("close")),
        F.struct(F.lit("^RF").alias("ticker"),
                 (4.0 + 10.0 * (F.col("sd") / F.lit(10000.0) / F.col("n"))).alias("close")),
        F.struct(F.lit("^VIX").alias("ticker"),
                 (12.0 + 100.0 * (F.col("st") / F.lit(10000.0) / F.col("n"))).alias("close")),
    )
    return day.select("date", F.inline(series)).select("ticker", "date", "close")


def prices(spark, sf_dir) -> DataFrame:
    return company_prices(spark, sf_dir).unionByName(macro_prices(spark, sf_dir))


def _keys(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))


def splits(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    return _keys(spark, sf_dir).filter((k % 10).isin(3, 6)).select(
        ticker_of(k).alias("ticker"),
        F.when(k % 10 == 3, F.lit("1999-06-15")).otherwise(F.lit("2001-08-01"))
        .cast("date").alias("date"),
        F.when(k % 10 == 3, F.lit(2.0)).otherwise(F.lit(3.0)).alias("ratio"),
    )


def shares(spark, sf_dir) -> DataFrame:
    """Yearly counts, stated before any later split."""
    k, y = F.col("k"), F.col("y")
    later = F.when((k % 10 == 3) & (y <= 1999), F.lit(2.0)).when(
        k % 10 == 6, F.when(y <= 2001, F.lit(3.0)).otherwise(F.lit(1.0))
    ).otherwise(F.lit(1.0))
    return (
        _keys(spark, sf_dir).filter(~mod(k, 5))
        .withColumn("y", F.explode(F.sequence(F.lit(1996), F.lit(2001))))
        .select(
            ticker_of(k).alias("ticker"),
            F.make_date(y, F.lit(1), F.lit(15)).alias("date"),
            ((100000.0 + 1000.0 * (k % 7)) / later).alias("shares"),
        )
    )


def positions(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    value = 2000.0 + 500.0 * (k % 30)
    price = 50.0 + (k % 60)
    return _keys(spark, sf_dir).filter(mod(k, 4)).select(
        F.when(mod(k, 40), F.concat(F.lit("SPY"), ticker_of(k))).otherwise(ticker_of(k))
        .alias("symbol"),
        F.when(mod(k, 40), F.lit("us_option")).otherwise(F.lit("us_equity")).alias("asset_class"),
        (value / price).alias("qty"),
        value.alias("market_value"),
        price.alias("current_price"),
        (45.0 + (k % 70)).alias("avg_entry_price"),
    )


def order_events(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "new").when(kind == "click", "partially_filled")
        .when(kind == "purchase", "filled").when(kind == "error", "rejected")
        .otherwise("accepted")
    )
    filled = F.when(kind.isin("purchase", "click"), F.col("value")).otherwise(F.lit(0.0))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("order_id"),
        ticker_of(F.col("user_id") % 100).alias("symbol"),
        F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        status.alias("status"),
        filled.alias("filled_qty"),
        F.when(filled > 0, 50.0 + F.col("user_id") % 60).alias("filled_avg_price"),
        "ts",
        "event_id",
    )


def access_events(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase"))
        .select(
            F.col("user_id").cast("string").alias("key"), "ts", "event_id",
            (F.col("event_type") == "purchase").alias("success"),
        )
    )


def option_chain(spark, sf_dir) -> DataFrame:
    """Contracts spread over expiries and strikes, one per part key."""
    k = F.col("p_partkey")
    symbol = F.concat(F.lit("SPY"), F.lpad(k.cast("string"), 7, "0"))
    return table(spark, sf_dir, "part").select(
        symbol.alias("symbol"), F.substring(symbol, 1, 3).alias("underlying"),
        F.date_add(F.lit("2001-07-01").cast("date"), (k % 61).cast("int"))
        .alias("expiration_date"),
        (80.0 + (k % 53)).alias("strike_price"),
        (k % 3 != 0).alias("tradable"),
        k.cast("int").alias("chain_pos"),
    )


def trade_logs(spark, sf_dir) -> DataFrame:
    """Confirmed fills plus periodic portfolio risk rows."""
    e = table(spark, sf_dir, "events")
    uid, v = F.col("user_id"), F.col("value")
    snap = F.col("event_type") == "signup"
    none = F.lit(None).cast("double")
    return e.filter(F.col("event_type").isin("purchase", "signup")).select(
        "ts", "event_id",
        F.when(snap, F.lit("PORTFOLIO")).otherwise(ticker_of(uid % 100)).alias("ticker"),
        F.when(snap, F.lit("RISK_SNAPSHOT")).when(uid % 2 == 0, "BUY").otherwise("SELL")
        .alias("action"),
        F.when(snap, F.lit(0.0)).otherwise(v).alias("quantity"),
        F.when(snap, F.lit(0.0)).otherwise(50.0 + uid % 60).alias("execution_price"),
        F.when(~snap, 0.05 + (uid % 15) / 100.0).alias("wacc"),
        F.when(~snap, 0.4 + 0.1 * (uid % 13)).alias("beta"),
        F.when(~snap, v / 100.0).alias("conviction_score"),
        F.when(~snap, 1.0 + (uid % 30) / 10.0).alias("altman_z_score"),
        F.when(snap & (uid % 5 != 0), -v / 1000.0).otherwise(none).alias("var_95"),
        F.when(snap & (uid % 5 != 0), -v / 700.0).otherwise(none).alias("cvar_95"),
    )


def backtest_curve(spark, sf_dir) -> DataFrame:
    """Monthly curve: average order value of even keys against all orders."""
    o = table(spark, sf_dir, "orders")
    cents = F.col("o_totalprice").cast("decimal(18,2)")
    late = F.when(F.col("o_orderkey") % 2 == 0, cents)
    return o.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("date")).agg(
        (F.sum(late).cast("double") / F.count(late)).alias("strategy_value"),
        (F.sum(cents).cast("double") / F.count(cents)).alias("benchmark_value"),
    )


def news_raw(spark, sf_dir) -> DataFrame:
    """Eight items per ticker: even pages nested, odd pages flat, every seventh untitled."""
    n = F.col("page_id")
    title = F.when(n % 7 != 0, F.concat(F.lit("Story "), n))
    publisher = F.concat(F.lit("P"), n % 5)
    day = F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))

    def body(with_flat):
        fields = [
            title.alias("title"),
            F.struct(publisher.alias("displayName")).alias("provider"),
            F.when(n % 3 == 0, F.struct(F.col("url").alias("url"))).alias("canonicalUrl"),
            F.struct(F.concat(F.col("url"), F.lit("#click")).alias("url")).alias("clickThroughUrl"),
            day.alias("pubDate"),
        ]
        if with_flat:
            fields += [
                publisher.alias("publisher"), F.col("url").alias("link"),
                (F.lit(1700000000) + n).alias("providerPublishTime"),
            ]
        return F.struct(*fields)

    item = F.when(n % 2 == 0, F.to_json(F.struct(body(False).alias("content")))).otherwise(
        F.to_json(body(True))
    )
    return (
        table(spark, sf_dir, "pages")
        .select(ticker_of(F.floor(n / 8)).alias("ticker"), F.struct(n.alias("p"), item.alias("j"))
                .alias("e"))
        .groupBy("ticker")
        .agg(F.array_sort(F.collect_list("e")).alias("es"))
        .select("ticker", F.concat(F.lit("["), F.array_join(F.col("es.j"), ","), F.lit("]"))
                .alias("items"))
    )


# Tag names of the regulatory facts.
TAGS = {
    "revenue": "RevenueFromContractWithCustomerExcludingAssessedTax",
    "revenue_old": "Revenues",
    "ebit": "OperatingIncomeLoss",
    "pretax": "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItems"
              "NoncontrollingInterest",
    "tax": "IncomeTaxExpenseBenefit",
    "interest": "InterestExpense",
    "interest_other": "InterestExpenseNonoperating",
    "cash": "CashAndCashEquivalentsAtCarryingValue",
    "debt_long": "LongTermDebtNoncurrent",
    "debt_short": "LongTermDebtCurrent",
    "debt_all": "DebtLongtermAndShorttermCombinedAmount",
}


def xbrl_rows(spark, sf_dir) -> DataFrame:
    """Flat facts: the original filing, a restated copy, a quarter and an interim form."""
    k, fy, rev, ret, ep = (F.col(c) for c in ("k", "fy", "rev", "ret", "ep"))
    ebit = F.when(mod(k, 41), -0.05 * rev).otherwise(0.35 * rev - 0.4 * ret)
    interest = 0.02 * ep

    def fact(tag, value, keep=None, instant=False):
        val = value if keep is None else F.when(keep, value)
        return F.struct(F.lit(TAGS[tag]).alias("tag"), val.alias("val"),
                        F.lit(instant).alias("instant"))

    old = (k % 3 == 0) & (fy <= 1998)
    facts = F.array(
        fact("revenue", rev, ~((k % 3 == 0) & (fy <= 1997))),
        fact("revenue_old", rev + 1, old),
        fact("ebit", ebit),
        fact("pretax", ebit - interest),
        fact("tax", F.col("tax"), ~(mod(k, 13) & (fy == 2000))),
        fact("interest", interest, k % 4 != 0),
        fact("interest_other", interest, k % 4 == 0),
        fact("cash", 0.1 * rev, ~mod(k, 11), True),
        fact("debt_long", 0.3 * rev, k % 5 != 0, True),
        fact("debt_short", 0.1 * rev, k % 5 != 0, True),
        fact("debt_all", 0.4 * rev, k % 5 == 0, True),
    )
    copies = F.array(*[
        F.struct(F.lit(pos).alias("copy"), F.lit(form).alias("form"),
                 F.lit(scale).alias("scale"), F.lit(month).alias("start_month"),
                 F.lit(delay).alias("delay"))
        for pos, form, scale, month, delay in (
            (0, "10-Q", 0.25, 10, 20),
            (1, "10-K", 0.25, 10, 45),
            (2, "10-K", 1.0, 1, 45),
            (3, "10-K", 1.01, 1, 410),
        )
    ])
    end = F.make_date(fy, F.lit(12), F.lit(31))
    year = F.lpad(((fy + 1) % 100).cast("string"), 2, "0")
    return (
        base_facts(spark, sf_dir)
        .select("k", "fy", F.inline(facts))
        .filter("val is not null")
        .select("k", "fy", "tag", "val", "instant", F.inline(copies))
        .filter("not instant or copy <> 1")
        .select(
            ticker_of(k).alias("ticker"), (1000 + k).cast("string").alias("cik"), "tag", "copy",
            "form",
            F.when(~F.col("instant"), F.make_date(fy, F.col("start_month"), F.lit(1)))
            .alias("start"),
            end.alias("end"), (F.col("val") * F.col("scale")).alias("val"),
            F.concat(F.lpad((1000 + k).cast("string"), 10, "0"), F.lit("-"), year, F.lit("-"),
                     F.lpad(F.col("copy").cast("string"), 6, "0")).alias("accn"),
            F.date_add(end, F.col("delay")).alias("filed"),
        )
    )


def xbrl_facts_raw(spark, sf_dir) -> DataFrame:
    """One JSON document per company: tag -> units -> USD -> facts in filing order."""
    fact = F.struct("end", "copy", "form", "start", "val", "accn", "filed")
    per_tag = xbrl_rows(spark, sf_dir).groupBy("ticker", "cik", "tag").agg(
        F.array_sort(F.collect_list(fact)).alias("facts")
    )
    units = F.struct(F.create_map(F.lit("USD"), F.col("facts")).alias("units"))
    return per_tag.groupBy("ticker", "cik").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("tag"), units)))).alias("facts")
    )


def snapshots_raw(spark, sf_dir) -> DataFrame:
    """One JSON document per company file; some are malformed, mislabelled or incomplete."""
    k, fy, rev, ret, ep = (F.col(c) for c in ("k", "fy", "rev", "ret", "ep"))
    ebit = F.when(mod(k, 41), -0.05 * rev).otherwise(0.35 * rev - 0.4 * ret)
    accn = F.concat(F.lpad((1000 + k).cast("string"), 10, "0"), F.lit("-"), fy, F.lit("-000002"))
    year = F.struct(
        F.concat(fy, F.lit("-12-31")).alias("fiscal_period_end"),
        rev.alias("revenue_raw_usd"), ebit.alias("ebit_raw_usd"),
        F.lit(TAGS["revenue"]).alias("revenue_xbrl_tag"), accn.alias("revenue_accession"),
        F.concat(F.lit("https://filings.example.org/"), accn).alias("revenue_source_url"),
        F.concat(fy + 1, F.lit("-02-14")).alias("revenue_filed_date"),
    )
    latest = F.struct(
        (ebit - 0.02 * ep).alias("pretax_income_usd"), F.col("tax").alias("tax_provision_usd"),
        (0.02 * ep).alias("interest_expense_usd"), (0.4 * rev).alias("total_debt_usd"),
        F.when(~mod(k, 11), 0.1 * rev).alias("cash_and_equivalents_usd"),
        accn.alias("pretax_income_accession"),
    )
    per = base_facts(spark, sf_dir).groupBy("k").agg(
        F.array_sort(F.collect_list(year)).alias("h"), F.max_by(latest, fy).alias("l")
    )
    c = companies(spark, sf_dir).withColumn("k", F.col("universe_pos").cast("bigint"))
    doc = F.to_json(F.struct(
        F.when(mod(k, 18), F.concat(F.lit("X"), F.col("ticker"))).otherwise(F.col("ticker"))
        .alias("ticker"),
        F.when(mod(k, 24), "").otherwise(F.concat(F.lit("Company "), k)).alias("entity_name"),
        F.lpad((1000 + k).cast("string"), 10, "0").alias("cik"),
        F.when(mod(k, 26), "2002-12-31").otherwise("2000-12-31")
        .alias("latest_complete_fiscal_year_end"),
        F.when(mod(k, 27), F.array_compact(F.slice("h", 1, 0))).otherwise(F.col("h"))
        .alias("historical_annual_data"),
        F.col("l").alias("latest_year_facts"),
        F.struct(
            F.col("alt_price").alias("current_price_usd_per_share"), "shares_outstanding",
            F.col("beta").alias("beta_levered_equity"), F.col("sector").alias("sector_gics"),
            F.lit("2001-06-30T00:00:00Z").alias("retrieved_at_utc"),
        ).alias("market_data"),
    ))
    return per.join(c, "k").select(
        F.col("ticker").alias("file_ticker"), k.alias("k"),
        F.when(mod(k, 21), F.substring(doc, 1, 12)).otherwise(doc).alias("doc"),
    )


def median_documents(spark, sf_dir) -> DataFrame:
    """One stored snapshot per nation, each with one of twelve conditions."""
    n = F.col("n_nationkey")
    kind = n % 12
    stats = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == n)
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name")
        .agg((F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / 1e6).alias("m"),
             (F.count(F.lit(1)) % 5).alias("c"))
    )
    maps = stats.agg(
        F.map_from_entries(F.collect_list(F.struct("r_name", "m"))).alias("sector_medians"),
        F.map_from_entries(F.collect_list(F.struct("r_name", "c"))).alias("sector_sample_counts"),
    )
    stamp = (
        F.when(kind == 3, "yesterday").when(kind == 4, "2001-06-30T12:00:00")
        .when(kind == 5, "2001-06-27T12:00:00+00:00").when(kind == 2, F.lit(None))
        .otherwise("2001-06-30T12:00:00+00:00")
    )
    doc = F.to_json(F.struct(
        stamp.alias("generated_at"),
        F.when(kind == 6, F.lit(None)).when(kind == 8, 0).otherwise(100).alias("universe_size"),
        F.when(kind == 7, -1).when(kind == 9, 49).otherwise(80).alias("tickers_used"),
        F.when(kind != 11, F.lit(0.045)).alias("risk_free_rate"),
        F.struct(F.when(kind == 10, 0.03).otherwise(0.025).alias("terminal_growth_rate"))
        .alias("assumptions"),
        "sector_medians", "sector_sample_counts",
    ))
    both = {c: maps.select(c).scalar() for c in ("sector_medians", "sector_sample_counts")}
    return table(spark, sf_dir, "nation").withColumns(both).select(
        n.alias("doc_id"), F.when(kind == 1, F.substring(doc, 1, 40)).otherwise(doc).alias("doc")
    )


def portfolio_picks(spark, sf_dir) -> DataFrame:
    """All companies of each industry, as one portfolio per industry."""
    from pyspark.sql import Window

    w = Window.partitionBy("industry").orderBy("universe_pos")
    return (
        companies(spark, sf_dir).withColumn("pick_rank", F.row_number().over(w))
        .select(F.col("industry").alias("portfolio_id"), "ticker", "sector", "beta", "pick_rank")
    )


def targets(spark, sf_dir) -> DataFrame:
    """Names to hold: all companies that move no more than the market; unknown betas count as one."""
    return companies(spark, sf_dir).filter(F.coalesce("beta", F.lit(1.0)) <= 1).select("ticker")


def holdings(spark, sf_dir) -> DataFrame:
    """One portfolio per nation: the five region series and a name without prices."""
    n = F.col("n_nationkey")
    slots = F.array(*[
        F.struct(F.lit(f"R_{r}").alias("ticker"), (((n + i) % 4) / 10.0).alias("weight"))
        for i, r in enumerate(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
    ], F.struct(F.lit("UNPRICED").alias("ticker"), ((n % 10) / 5.0).alias("weight")))
    single = F.array(
        F.struct(F.when(n % 12 == 5, "IDX").otherwise("UNPRICED").alias("ticker"),
                 F.lit(0.9).alias("weight"))
    )
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("P"), n).alias("portfolio_id"),
        F.inline(F.when(n % 6 == 5, single).otherwise(slots)),
    )


def risk_prices(spark, sf_dir) -> DataFrame:
    return region_prices(spark, sf_dir).unionByName(
        macro_prices(spark, sf_dir).filter("ticker = 'IDX'")
    )


def region_curves(spark, sf_dir) -> DataFrame:
    """Daily curve of each region against the index."""
    idx = macro_prices(spark, sf_dir).filter("ticker = 'IDX'").select(
        "date", F.col("close").alias("benchmark")
    )
    return region_prices(spark, sf_dir).join(idx, "date").select(
        "ticker", "date", F.col("close").alias("strategy"), "benchmark"
    )


def hedge_positions(spark, sf_dir) -> DataFrame:
    """Held options over all strikes, plus ordinary equities that must be ignored."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("SPY"), F.lpad(k.cast("string"), 7, "0")).alias("symbol"),
        F.when(k % 5 == 0, "us_equity").otherwise("us_option").alias("asset_class"),
        (1.0 + k % 2).alias("qty"), (0.001 * (1 + k % 3)).alias("market_value"),
    )


def hedge_requests(spark, sf_dir) -> DataFrame:
    """Most ask for the quoted underlying, some for one without contracts or without a quote."""
    c = F.col("c_custkey")
    equity = 50000.0 + 1000.0 * (c % 100)
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("portfolio_id"),
        F.when(c % 17 == 0, "QQQ").when(c % 19 == 0, "IWM").otherwise("SPY").alias("underlying"),
        equity.alias("equity"), F.col("c_acctbal").alias("var_dollars"),
        F.when(c % 3 != 0, 0.01 * equity * (c % 5)).alias("buying_power"),
    )
