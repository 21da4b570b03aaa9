"""Projections, filters and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.functions import text
from tidemark.functions.numeric import is_finite, positive_whole
from tidemark.operators import asof, evaluate, fundamentals as fu, orders
from tidemark.plans.registry import query
from tidemark.sources import integrity


@query(money=("value",))
def f1_line_item_lookup(t):
    out = None
    for item in ("revenue", "ebit", "cash", "total_debt", "ocf"):
        part = fu.line_item_latest(t.statements, item).withColumn("item", F.lit(item))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def f2_filing_lag(t):
    """Visible rows per date with the usual lag and with none."""
    out = None
    for lag in (90, 0):
        seen = fu.periods_on_or_before(t.statements, ["2000-03-30", "2000-03-31", *fx.AS_OF], lag)
        part = seen.groupBy("ticker", "as_of").agg(
            F.lit(lag).alias("lag_days"), F.count(F.lit(1)).alias("visible_rows"),
            F.max("period_end").alias("newest_period"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query()
def f3_zone_drop(t):
    shown = F.concat(F.col("ts").cast("string"), F.lit("+05:30"))
    naive = text.wall_time(shown)
    return t.raw("events").select(
        "event_id", naive.cast("date").alias("day"), F.hour(naive).alias("hour"),
        F.minute(naive).alias("minute"),
    )


def _odd_number(k, value):
    return (
        F.when(k % 7 == 0, "0.05").when(k % 7 == 1, "not-a-number").when(k % 7 == 2, "NaN")
        .when(k % 7 == 3, "Infinity").when(k % 7 == 4, "-Infinity").when(k % 7 == 5, "")
        .otherwise(value.cast("string"))
    )


@query()
def f4_finite_numbers(t):
    number = _odd_number(F.col("event_id"), F.col("value")).try_cast("double")
    return t.raw("events").select("event_id", is_finite(number).alias("usable"))


@query()
def f5_capital_checks(t):
    """Sign errors planted in every input; the first one in field order is named."""
    c = F.col("c_custkey")
    bal = F.col("c_acctbal")
    rows = t.raw("customer").select(
        "c_custkey",
        F.when(c % 5 == 0, -bal).otherwise(F.abs(bal)).alias("price"),
        F.when(c % 7 == 0, F.lit(float("inf"))).otherwise(F.lit(100.0)).alias("shares"),
        F.when(c % 3 == 0, F.lit(None).cast("double")).otherwise(bal).alias("total_debt"),
        F.when(c % 11 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("cash"),
    )
    return rows.select("c_custkey", fu.capital_input_error().alias("problem"))


def valuation_requests(t):
    """One request per company; some assumptions lie outside their bounds."""
    k = F.col("universe_pos")
    return t.companies.select(
        "ticker", "universe_pos",
        F.when(k % 4 != 0, (k % 60) / 100.0 - 0.15).alias("growth_request"),
        F.when(k % 3 != 0, (k % 70) / 100.0).alias("margin_request"),
        ((k % 8) / 100.0).alias("terminal_request"),
    )


@query()
def f6_assumption_checks(t):
    return valuation_requests(t).select("ticker", evaluate.assumption_problem().alias("problem"))


@query()
def f7_whole_numbers(t):
    shifted = F.col("p_retailprice") - 1000.0
    return t.raw("part").select("p_partkey", positive_whole(shifted).alias("whole"))


@query()
def f13_asset_split(t):
    """Equities apart from options on the hedged underlying."""
    kind = F.when(F.col("asset_class") == "us_equity", "equity").when(
        (F.col("asset_class") == "us_option") & F.startswith("symbol", F.lit("SPY")), "hedge"
    ).otherwise("other")
    return t.positions.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("positions"), F.sum("market_value").alias("market_value")
    )


@query()
def f14_duplicate_guard(t):
    from tidemark.sources.market import open_order_symbols

    plan = t.companies.select(F.col("ticker").alias("symbol"))
    return orders.without_duplicates(plan, open_order_symbols(t.order_events, orders.TERMINAL))


@query()
def f18_safe_links(t):
    n = F.col("page_id")
    link = F.when(n % 10 == 0, "javascript:alert(1)").when(n % 10 == 1, "no address").when(
        n % 10 == 2, "HTTPS://shout.example.org"
    ).otherwise(F.col("url"))
    return t.raw("pages").select("page_id", text.safe_link(link).alias("href"))


@query()
def f19_email_scan(t):
    return integrity.email_leaks(t.raw("documents")).select("doc_id", "match_pos", "address")


@query()
def f20_assumption_source(t):
    def source(c):
        return F.when(F.col(c).isNull(), "historical").otherwise("custom")

    return valuation_requests(t).select(
        "ticker", source("growth_request").alias("growth_source"),
        source("margin_request").alias("margin_source"),
    )


@query()
def f21_pseudonyms(t):
    messy = F.concat(F.lit(" "), F.upper("c_name"), F.lit("  "))
    return t.raw("customer").select(
        "c_custkey", text.pseudonym(messy, b"an example key").alias("digest")
    )


@query()
def j1_as_of_price(t):
    return asof.as_of_price(t.company_prices, fx.AS_OF)


@query()
def j1_as_of_price_dense(t):
    """A request per company and month end."""
    months = F.sequence(
        F.lit("1995-01-31").cast("date"), F.lit("2001-12-31").cast("date"),
        F.expr("interval 1 month"),
    )
    requests = t.companies.select("ticker", F.explode(months).alias("as_of"))
    return asof.as_of_price_dense(t.company_prices, requests, 10)


@query()
def j2_as_of_shares(t):
    return asof.as_of_shares(t.shares, t.splits, t.companies, fx.AS_OF)


@query()
def a1_split_factor(t):
    return asof.split_factor(t.splits, ["1999-01-01", *fx.AS_OF])


@query()
def j11_scenario_grid(t):
    """Every company against every growth value; a literal array, so no join."""
    from tidemark.functions.numeric import double_array
    from tidemark.params import SensitivityGrids

    return t.companies.select("ticker", F.explode(double_array(SensitivityGrids().growth)).alias("growth"))


@query(money=("revenue", "prior_revenue"))
def w1_two_periods(t):
    """Current and prior period of the income statement; a lone period stands for both."""
    q = fu.quality_facts(t.statements, [("1995-12-31", "1995-12-31"), (fx.LAST_DAY, fx.LAST_DAY)])
    return q.select("ticker", "as_of", "income_period", "income_prior_period", "revenue",
                    "prior_revenue", fu.f_score().cast("bigint").alias("f_score"))
