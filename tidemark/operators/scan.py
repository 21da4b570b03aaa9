"""Sector medians, two-pass scoring, ranking and the entry gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import clamp, first_reason, ratio
from tidemark.functions.valuation import saturate
from tidemark.operators.quantiles import grouped_median
from tidemark.params import GateParams, ScanParams


def sector_medians(valuations: DataFrame) -> DataFrame:
    """Exact median ratio and sample count per (as_of, sector) over valid rows."""
    return grouped_median(
        valuations.filter("skip_reason is null"), ("as_of", "sector"), "price_to_intrinsic",
        "sector_median",
    )


def with_medians(valuations: DataFrame, medians: DataFrame) -> DataFrame:
    return valuations.join(
        medians.select("as_of", "sector", "sector_median"), ["as_of", "sector"], "left"
    )


def passes_sector_filter() -> Column:
    return F.col("price_to_intrinsic") <= F.col("sector_median")


def conviction(s: ScanParams = ScanParams()) -> Column:
    floored = F.greatest(F.col("price_to_intrinsic"), F.lit(s.piv_floor))
    raw = F.col("fcf_growth") * F.col("roic") / floored
    return saturate(raw, s.conviction_cap, s.conviction_half)


def score(valuations: DataFrame, medians: DataFrame, s: ScanParams = ScanParams()) -> DataFrame:
    """Second pass. A row keeps only the columns known at the step where it stopped."""
    j = with_medians(valuations, medians)
    valued = F.col("skip_reason").isNull()
    has_median = valued & F.col("sector_median").isNotNull()
    compared = has_median & passes_sector_filter()
    measured = compared & F.col("fcf_growth").isNotNull() & F.col("roic").isNotNull()
    scored = measured & (F.col("fcf_growth") > 0) & (F.col("roic") > 0)
    reason = F.coalesce(
        F.col("skip_reason"),
        first_reason(
            (F.col("sector_median").isNull(), "no_sector_median"),
            (~passes_sector_filter(), "above_sector_median"),
            (F.col("fcf_growth").isNull(), "no_fcf_growth"),
            (F.col("roic").isNull(), "no_roic"),
            ((F.col("fcf_growth") <= 0) | (F.col("roic") <= 0), "not_compounding"),
        ),
    )
    keep = {
        "sector_median": has_median,
        "fcf_growth": measured,
        "roic": measured,
        "beta": scored,
        "fcf_yield": scored,
    }
    notes = F.when(valued & F.col("sector_median").isNull(), F.array().cast("array<string>"))
    return j.select(
        "ticker", "as_of", "sector", "universe_pos", "price", "intrinsic_value",
        "price_to_intrinsic", "wacc",
        *[F.when(cond, F.col(c)).alias(c) for c, cond in keep.items()],
        F.when(scored, conviction(s)).alias("conviction"),
        reason.alias("skip_reason"),
        F.coalesce(notes, F.col("approximations")).alias("approximations"),
    )


def top_picks(scores: DataFrame, n: int = 10) -> DataFrame:
    """Best n per date, ties in universe order; the rank filter is pushed below the shuffle."""
    w = Window.partitionBy("as_of").orderBy(F.desc("conviction"), F.asc("universe_pos"))
    return (
        scores.filter("skip_reason is null and conviction is not null")
        .withColumn("pick_rank", F.row_number().over(w))
        .filter(F.col("pick_rank") <= n)
    )


def blend_with_yield(scores: DataFrame, s: ScanParams = ScanParams()) -> DataFrame:
    part = clamp(
        F.coalesce("fcf_yield", F.lit(0.0)) * s.yield_factor, 0.0, s.yield_cap
    )
    return scores.withColumn(
        "conviction", F.col("conviction") * s.conviction_weight + part * s.yield_weight
    )


def altman_fails(z, sector, g: GateParams = GateParams()) -> Column:
    z, sector = F.col(z), F.col(sector)
    return ~sector.isin(*g.altman_exempt) & (z.isNull() | (z < g.altman_floor))


def gate_reason(g: GateParams = GateParams()) -> Column:
    """First failing entry gate; a missing signal fails its gate."""
    return first_reason(
        (altman_fails("altman_z", "sector", g), "altman_distress"),
        (~F.coalesce("trend_ok", F.lit(False)), "below_trend"),
        (F.coalesce("f_score", F.lit(0)) < g.min_f_score, "weak_f_score"),
        (F.col("rsi").isNull() | (F.col("rsi") >= g.rsi_ceiling), "rsi_not_low"),
    )


def apply_gates(scores: DataFrame, signals: DataFrame, g: GateParams = GateParams()) -> DataFrame:
    """Gates act on rows that are still valid, after the medians were taken."""
    j = scores.join(signals, ["ticker", "as_of"], "left")
    valid = F.col("skip_reason").isNull()
    gate = F.when(valid, gate_reason(g))
    return j.withColumn("gate", gate).withColumns({
        "skip_reason": F.coalesce("skip_reason", "gate"),
        "conviction": F.when(F.col("gate").isNull(), F.col("conviction")),
    }).drop("gate")


def run_tally(valuations: DataFrame) -> DataFrame:
    return valuations.groupBy(
        "as_of", F.coalesce("skip_reason", F.lit("valid")).alias("outcome")
    ).agg(F.count(F.lit(1)).alias("companies"))


def comparison_bars(df: DataFrame) -> DataFrame:
    """Pass flag and bar lengths of a company against its sector median."""
    scale = F.greatest("price_to_intrinsic", "sector_median") * 1.15
    return df.filter(
        F.col("price_to_intrinsic").isNotNull() & F.col("sector_median").isNotNull()
    ).withColumns({
        "passes": passes_sector_filter(),
        "stock_bar": F.least(ratio("price_to_intrinsic", scale) * 100, F.lit(100.0)),
        "median_bar": F.least(ratio("sector_median", scale) * 100, F.lit(100.0)),
    })


def upside(df: DataFrame) -> DataFrame:
    delta = F.col("intrinsic_value") - F.col("price")
    return df.withColumns({"upside": delta, "upside_pct": ratio(delta, F.nullif("price", F.lit(0.0)))})
