"""Sector medians, scoring, gates and the daily scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.operators import asof, evaluate, lookup, scan, screens
from tidemark.operators.fundamentals import fold_periods
from tidemark.params import GateParams
from tidemark.plans.common import landed_valuations, market_rows
from tidemark.plans.registry import query
from tidemark.plans.selection import valuation_requests
from tidemark.session import land

# Prices are sparse here, so the momentum gate looks at a year instead of three months.
GATES = GateParams(rsi_months=12)
NOW = "2001-07-01 12:00:00"


def scores(t, dates=fx.AS_OF, statements=None):
    v = landed_valuations(t, dates, statements=statements)
    return scan.score(v, scan.sector_medians(v))


def _flat(df):
    return df.withColumn("approximations", F.array_join("approximations", ","))


@query()
def a2_sector_medians(t):
    return scan.sector_medians(landed_valuations(t)).drop("sample_count")


@query()
def a3_sample_counts(t):
    v = landed_valuations(t)
    return v.filter("skip_reason is null").groupBy("as_of", "sector").agg(
        F.count(F.lit(1)).alias("sample_count")
    )


def quoted_valuations(t, as_of=fx.AS_OF[1]):
    """Ratios from current quotes instead of as-of prices."""
    from tidemark.operators.fundamentals import valuation_inputs
    from tidemark.operators.valuation import value_companies
    from tidemark.sources.statements import current_quotes

    q = current_quotes(t.companies).withColumnsRenamed(
        {"current_price": "price", "shares_outstanding": "shares"}
    )
    rows = q.join(valuation_inputs(t.statements, [(as_of, as_of)]), "ticker", "left").drop("as_of")
    rows = rows.withColumn("as_of", F.lit(as_of).cast("date")).join(
        asof.risk_free(t.macro_prices, [as_of]), "as_of"
    )
    v = value_companies(rows)
    iv = F.col("intrinsic_value")
    ok = F.col("dcf_error").isNull() & (iv > 0) & (F.col("price") != 0)
    return v.select(
        "ticker", "as_of", "sector", "risk_free",
        F.when(ok, F.col("price") / iv).alias("price_to_intrinsic"),
        F.when(~F.coalesce(ok, F.lit(False)), "unusable").alias("skip_reason"),
    )


@query()
def a4_universe_snapshot(t):
    v = land(quoted_valuations(t), "quoted")
    totals = v.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("universe_size"),
        F.count_if(F.col("skip_reason").isNull()).alias("tickers_used"),
        F.max("risk_free").alias("risk_free_rate"),
    )
    return scan.sector_medians(v).join(totals, "as_of")


@query()
def a17_run_tally(t):
    return scan.run_tally(landed_valuations(t))


@query()
def f8_sector_filter(t):
    v = landed_valuations(t)
    j = scan.with_medians(v, scan.sector_medians(v)).filter("skip_reason is null")
    return j.select("ticker", "as_of", scan.passes_sector_filter().alias("passes"))


@query()
def f9_compounder_gate(t):
    v = market_rows(t)
    from tidemark.operators.valuation import valuations

    rows = valuations(v).filter("skip_reason is null")
    return rows.select(
        "ticker", "as_of", F.coalesce(
            (F.col("fcf_growth") > 0) & (F.col("roic") > 0), F.lit(False)
        ).alias("compounds"),
    )


@query()
def f11_entry_gates(t):
    signals = screens.entry_signals(t.companies, t.statements, t.company_prices, fx.AS_OF[1], GATES)
    sector = t.companies.select("ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"))
    return signals.join(sector, "ticker").select(
        "ticker", scan.gate_reason(GATES).alias("gate")
    )


@query()
def f12_profit_take(t):
    held = t.positions.select(F.col("symbol").alias("ticker"), "current_price")
    v = landed_valuations(t).filter(F.col("as_of") == F.lit(fx.AS_OF[1]).cast("date"))
    j = held.join(v.select("ticker", "intrinsic_value"), "ticker", "left")
    take = F.coalesce(F.col("current_price") >= F.col("intrinsic_value"), F.lit(False))
    return j.select("ticker", take.alias("take_profit"))


@query()
def f15_comparison_bars(t):
    v = landed_valuations(t)
    j = scan.with_medians(v, scan.sector_medians(v))
    return scan.comparison_bars(j).select("ticker", "as_of", "passes", "stock_bar", "median_bar")


@query()
def f16_upside(t):
    from tidemark.operators.valuation import valuations

    return scan.upside(valuations(market_rows(t))).select("ticker", "as_of", "upside", "upside_pct")


@query()
def j3_sector_median_join(t):
    v = landed_valuations(t)
    return scan.with_medians(v, scan.sector_medians(v)).select(
        "ticker", "as_of", "sector", "sector_median"
    )


@query()
def k1_top_picks(t):
    """Best ten names per date by conviction, cheap against their sector."""
    return scan.top_picks(scores(t), 10).select(
        "as_of", "pick_rank", "ticker", "sector", "price", "intrinsic_value",
        "price_to_intrinsic", "sector_median", "fcf_growth", "roic", "conviction",
    )


@query()
def k4_sectors_by_median(t):
    return scan.sector_medians(landed_valuations(t)).orderBy("as_of", "sector_median", "sector")


@query()
def x15_conviction(t):
    return scores(t).filter("conviction is not null").select("ticker", "as_of", "conviction")


@query()
def x16_scores(t):
    return _flat(scores(t))


@query()
def x17_yield_blend(t):
    return scan.blend_with_yield(scores(t)).select("ticker", "as_of", "fcf_yield", "conviction")


def daily_scan(t, as_of=fx.AS_OF[1]):
    """Value all, medians on the unscreened set, score, gate, blend."""
    periods = land(fold_periods(t.statements), "periods")
    signals = screens.entry_signals(t.companies, periods, t.company_prices, as_of, GATES)
    gated = scan.apply_gates(scores(t, (as_of,), periods), signals, GATES)
    return scan.blend_with_yield(gated)


@query()
def p11_daily_scan(t):
    return daily_scan(t).select(
        "ticker", "as_of", "sector", "price_to_intrinsic", "sector_median", "altman_z", "trend_ok",
        "rsi", F.col("f_score").cast("bigint").alias("f_score"), "conviction", "skip_reason",
    )


def stored_snapshot(t, as_of=fx.AS_OF[1]):
    """The scan's own medians as a stored document, read back."""
    v = land(quoted_valuations(t, as_of), "quoted")
    m = scan.sector_medians(v)
    totals = v.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("universe_size"),
        F.count_if(F.col("skip_reason").isNull()).alias("tickers_used"),
        F.max("risk_free").alias("risk_free_rate"),
    ).withColumns({
        "generated_at": F.lit("2001-06-30T18:00:00+00:00"),
        "assumptions": F.struct(F.lit(0.025).alias("terminal_growth_rate")),
    })
    return lookup.parse_documents(lookup.to_document(m, totals))


YEARS = tuple(f"fcf_{y}" for y in range(1, 6))


@query(money=("enterprise_value", "equity_value", *YEARS))
def p13_evaluate_requests(t):
    """A request per company, half of them with explicit assumptions, some of these out of bounds.

    Some companies are asked for twice, and some requests name no or an unknown company.
    """
    k = F.col("universe_pos")
    none = F.lit(None).cast("double")

    def request(ticker, growth=none, margin=none, terminal=none):
        return F.struct(ticker.alias("ticker"), growth.alias("growth_request"),
                        margin.alias("margin_request"), terminal.alias("terminal_request"))

    ticker = F.col("ticker")
    own = F.when(k % 2 == 0, request(ticker, terminal=F.lit(0.025))).otherwise(request(
        ticker, F.col("growth_request"), F.col("margin_request"), F.col("terminal_request")))
    more = F.when(k % 10 == 0, request(F.concat(F.lit("x"), ticker))).when(
        k % 10 == 1, request(F.lit("  "))).when(k % 10 == 2, request(F.lower(ticker)))
    r = valuation_requests(t).select(F.inline(F.array_compact(F.array(own, more))))
    out = evaluate.evaluate(
        r, t.companies, t.statements, t.macro_prices, stored_snapshot(t), fx.AS_OF[1], NOW
    )
    years = [F.col("projection")[i]["fcf"].alias(c) for i, c in enumerate(YEARS)]
    return out.select("*", *years).drop("projection")


@query()
def l1_median_lookup(t):
    """Every stored document asked for every sector at two rates."""
    docs = lookup.parse_documents(t.median_documents)
    sectors = F.array(*[F.lit(s) for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "NONE")])
    rates = F.array(F.lit(0.0451), F.lit(0.05))
    none = F.lit(None).cast("double")
    asked = docs.withColumn("sector", F.explode(sectors)).withColumn(
        "risk_free", F.explode(rates)
    ).withColumns({"growth_request": none, "margin_request": none, "terminal_request": F.lit(0.025)})
    return lookup.lookup(asked, NOW).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "sector", "risk_free", "sector_median",
        "unavailable_reason",
    )


@query()
def l2_tolerant_read(t):
    docs = lookup.parse_documents(t.median_documents)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "malformed",
        F.when(~F.col("malformed"), F.col("snapshot.universe_size")).alias("universe_size"),
        F.when(~F.col("malformed"), F.coalesce(F.size("snapshot.sector_medians"), F.lit(0)))
        .cast("bigint").alias("sectors"),
    )
