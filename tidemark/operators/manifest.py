"""Provenance manifest: building it, and finding gaps and contradictions in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import facts as fa

# Field names of the manifest.
HISTORY_FIELDS = {"revenue": "Revenue", "ebit": "EBIT/Operating Income"}
LATEST_FIELDS = {
    "pretax": "Pretax Income (latest)",
    "tax": "Tax Provision (latest)",
    "interest": "Interest Expense (latest)",
}
CASH = "Cash & Equivalents (latest)"
DERIVED = "Total Debt (latest, derived)"
REPORTED = "Total Debt (latest, reported)"
COMPONENT = "Total Debt component: "
MARKET_FIELDS = ("Current Price", "Shares Outstanding", "Beta", "Sector (GICS)")
COLUMNS = ("ticker", "field", "period", "raw_value", "units", "source_field", "accession",
           "source_url", "filed", "provenance")


def _rows(df: DataFrame, field: Column, provenance: Column) -> DataFrame:
    return df.select(
        "ticker", field.alias("field"), F.date_format("end", "yyyy-MM-dd").alias("period"),
        F.col("val").alias("raw_value"), F.lit("USD").alias("units"),
        F.col("tag").alias("source_field"), F.col("accn").alias("accession"),
        fa.filing_url("cik", "accn").alias("source_url"),
        F.date_format("filed", "yyyy-MM-dd").alias("filed"), provenance.alias("provenance"),
    )


def _named(mapping: dict) -> Column:
    out = F.lit(None).cast("string")
    for key, name in mapping.items():
        out = F.coalesce(out, F.when(F.col("field") == key, F.lit(name)))
    return out


def build(sheets, market: DataFrame) -> DataFrame:
    """One row per sourced fact of facts.company_sheets; an interest proxy is named as such.
    market: ticker, price, shares, beta, sector, retrieved_at."""
    fields, latest, at = sheets
    years = fa.history_years(fields).select("ticker", "end")
    history = fields.filter(F.col("field").isin(*HISTORY_FIELDS)).join(
        years, ["ticker", "end"], "left_semi")
    newest = fields.filter(F.col("field").isin(*LATEST_FIELDS)).join(latest, "ticker").filter(
        F.col("end") == F.col("latest_end"))
    cash = at.filter("field = 'cash'")
    debt = fa.debt_rollup(at)
    parts = fa.debt_components(at).filter("use = 'added'")
    derived = F.col("method") == "summed"
    totals = debt.select(
        "ticker", F.when(derived, DERIVED).otherwise(REPORTED).alias("field"),
        F.date_format("latest_end", "yyyy-MM-dd").alias("period"),
        F.col("total_debt").alias("raw_value"), F.lit("USD").alias("units"),
        F.when(derived, F.col("component_tags")).otherwise("reported").alias("source_field"),
        F.col("accessions").alias("accession"),
        F.when(derived, F.col("source_urls")).otherwise(F.lit("combined")).alias("source_url"),
        F.when(derived, F.col("filed_dates")).otherwise(F.lit("combined")).alias("filed"),
        F.when(derived, "derived (sum of components above)").otherwise("reported")
        .alias("provenance"),
    )
    none = F.lit(None).cast("string")
    quotes = F.array(*[
        F.struct(F.lit(name).alias("field"), F.col(c).cast("double").alias("raw_value"),
                 F.lit(unit).alias("units"))
        for name, c, unit in zip(MARKET_FIELDS, ("price", "shares", "beta", "no_value"),
                                 ("USD/share", "shares", "unitless", "category"))
    ])
    sides = market.withColumn("no_value", F.lit(None).cast("double")).select(
        "ticker", "retrieved_at", F.inline(quotes)
    ).select(
        "ticker", "field", F.col("retrieved_at").alias("period"), "raw_value", "units",
        F.concat(F.lit("quote feed "), "field").alias("source_field"), none.alias("accession"),
        F.concat(F.lit("https://quotes.example.org/"), "ticker").alias("source_url"),
        F.col("retrieved_at").alias("filed"), F.lit("reported (market)").alias("provenance"),
    )
    reported, method = F.lit("reported"), F.col("method")
    out = _rows(history, _named(HISTORY_FIELDS), reported)
    for part in (
        _rows(newest, _named(LATEST_FIELDS), method), _rows(cash, F.lit(CASH), reported),
        _rows(parts, F.concat(F.lit(COMPONENT), "tag"), F.lit("reported (component)")), totals, sides,
    ):
        out = out.unionByName(part)
    return out


def category() -> Column:
    return F.when(F.col("field").isin(*MARKET_FIELDS), "market").when(
        F.col("field") == DERIVED, "derived_rollup").otherwise("reported_fact")


def completeness_problems(rows: DataFrame) -> DataFrame:
    """Exact (ticker, field, column) of every missing or wrong provenance value."""
    kind = category()

    def need(column, ok, kinds):
        return F.when(kind.isin(*kinds) & ~F.coalesce(ok, F.lit(False)), F.lit(column))

    def filled(c):
        return F.length(c) > 0

    all_facts = ("reported_fact", "derived_rollup")
    checks = F.array_compact(F.array(
        need("accession", filled("accession"), all_facts),
        need("source_url", filled("source_url"), (*all_facts, "market")),
        need("filed", filled("filed"), all_facts),
        need("source_field", filled("source_field"), ("reported_fact",)),
        need("provenance", filled("provenance"), ("reported_fact",)),
        need("provenance", F.contains(F.lower("provenance"), F.lit("derived")), ("derived_rollup",)),
        need("period", filled("period"), ("market",)),
        need("source_field", F.startswith("source_field", F.lit("quote feed")), ("market",)),
    ))
    return rows.select("ticker", "field", F.explode(checks).alias("column_name"))


def structure_problems(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts and cross-checks per ticker. expected: ticker, history_years, pretax, tax, cash.

    Every check is a conditional aggregate, so one pass with map-side combine finds them all.
    """
    def count(name):
        return F.count_if(F.col("field") == name)

    comp = F.startswith("field", F.lit(COMPONENT))

    def value(name):
        return F.max(F.when(F.col("field") == name, F.col("raw_value")))

    singles = (*LATEST_FIELDS.values(), CASH, *MARKET_FIELDS)
    spaced = {"accession": "accession", "source_url": "source_url", "filed": "filed"}
    aggs = [count(n).alias(f"n_{i}") for i, n in enumerate(singles)]
    aggs += [count(n).alias(f"h_{k}") for k, n in HISTORY_FIELDS.items()]
    aggs += [
        count(DERIVED).alias("n_derived"), count(REPORTED).alias("n_reported"),
        F.count_if(comp).alias("n_components"),
        F.count_distinct(F.when(comp, F.col("field"))).alias("component_kinds"),
        F.sum(F.when(comp, F.col("raw_value"))).alias("component_sum"),
        value(DERIVED).alias("derived_value"),
        value(LATEST_FIELDS["pretax"]).alias("v_pretax"), value(LATEST_FIELDS["tax"]).alias("v_tax"),
        value(CASH).alias("v_cash"),
        *[F.array_sort(F.collect_set(F.when(comp, F.col(c)))).alias(f"set_{c}") for c in spaced],
        *[F.max(F.when(F.col("field") == DERIVED, F.col(c))).alias(f"joined_{c}") for c in spaced],
    ]
    per = expected.join(rows.groupBy("ticker").agg(*aggs), "ticker", "left")
    derived = F.col("n_derived") == 1
    flags = [
        (F.col("n_derived").isNull(), "no_rows"),
        *[(F.col(f"h_{k}") != F.col("history_years"), f"{k}_rows") for k in HISTORY_FIELDS],
        *[(F.col(f"n_{i}") != 1, f"count: {n}") for i, n in enumerate(singles)],
        (F.col("n_derived") + F.col("n_reported") != 1, "debt_rows"),
        (derived & (F.col("n_components") == 0), "derived_without_components"),
        ((F.col("n_reported") == 1) & (F.col("n_components") != 0), "reported_with_components"),
        (derived & (F.col("n_components") != F.col("component_kinds")), "duplicate_component"),
        (derived & (F.col("n_components") == F.col("component_kinds"))
         & (F.abs(F.col("component_sum") - F.col("derived_value"))
            > 1e-9 * F.abs("derived_value")), "component_sum"),
        *[(F.col(f"v_{c}") != F.col(c), f"value: {c}") for c in ("pretax", "tax", "cash")],
    ]
    for c in spaced:
        parts = F.transform(F.split(f"joined_{c}", ";"), lambda p: F.trim(p))
        flags += [
            (derived & F.exists(parts, lambda p: F.length(p) == 0), f"blank_{c}"),
            (derived & (F.size(parts) != F.size(F.array_distinct(parts))), f"repeated_{c}"),
            (derived & (F.array_sort(F.array_distinct(parts)) != F.col(f"set_{c}")), f"foreign_{c}"),
        ]
    problems = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in flags]))
    return per.select("ticker", F.explode(problems).alias("problem"))
