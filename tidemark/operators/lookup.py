"""Guarded sector-median lookup over stored snapshot documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numeric import first_reason, is_finite
from tidemark.params import LookupParams

DOCUMENT = (
    "generated_at string, universe_size double, tickers_used double, risk_free_rate double, "
    "assumptions struct<revenue_growth_rate: double, operating_margin: double, "
    "terminal_growth_rate: double>, sector_medians map<string, double>, "
    "sector_sample_counts map<string, double>, corrupt string"
)


def parse_documents(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Tolerant read: a broken document is tagged, never an error."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    parsed = docs.withColumn("snapshot", F.from_json(column, DOCUMENT, options))
    bad = F.col("snapshot").isNull() | F.col("snapshot.corrupt").isNotNull()
    return parsed.withColumn("malformed", bad).drop(column)


ASSUMPTIONS = {"growth_request", "margin_request", "terminal_request"}


def _refusal(now: Column, p: LookupParams, compare: bool) -> Column:
    """First reason not to trust the snapshot for a request, in a fixed order."""
    def s(name):
        return F.col(f"snapshot.{name}")

    stamp = F.try_to_timestamp(s("generated_at"))
    zoned = s("generated_at").rlike(r"(Z|[+-]\d\d:?\d\d)$")
    age = F.unix_seconds(now) - F.unix_seconds(stamp)
    size, used = s("universe_size"), s("tickers_used")
    cached, rf = s("assumptions"), s("risk_free_rate")
    same = compare and (
        cached.isNotNull()
        & cached["revenue_growth_rate"].eqNullSafe(F.col("growth_request"))
        & cached["operating_margin"].eqNullSafe(F.col("margin_request"))
        & cached["terminal_growth_rate"].eqNullSafe(F.col("terminal_request"))
    )
    median = F.try_element_at(s("sector_medians"), F.col("sector"))
    count = F.coalesce(F.try_element_at(s("sector_sample_counts"), F.col("sector")), F.lit(0.0))
    return first_reason(
        (F.col("malformed"), "malformed"),
        (s("generated_at").isNull(), "not_generated"),
        (stamp.isNull(), "bad_timestamp"),
        (~zoned, "naive_timestamp"),
        (age > p.max_age_hours * 3600, "stale"),
        (~is_finite(size) | (size < 0), "bad_universe_size"),
        (~is_finite(used) | (used < 0), "bad_tickers_used"),
        (size <= 0, "empty_universe"),
        (F.try_divide(used, size) < p.min_coverage, "low_coverage"),
        (~same if compare else F.lit(False), "different_assumptions"),
        (~is_finite(rf), "bad_cached_rate"),
        (~is_finite("risk_free"), "bad_requested_rate"),
        (F.abs(F.col("risk_free") - rf) > p.rf_tolerance, "rate_differs"),
        (s("sector_medians").isNull(), "no_medians"),
        (median.isNull(), "no_sector"),
        (~is_finite(median), "invalid_median"),
        (s("sector_sample_counts").isNull(), "no_sample_counts"),
        (~is_finite(count) | (count < p.min_samples), "too_few_samples"),
    )


def lookup(requests: DataFrame, now, p: LookupParams = LookupParams()) -> DataFrame:
    """Requests already joined to their parsed snapshot; exactly one of value and reason is set.

    Requests without columns for assumptions take any snapshot's.
    """
    reason = _refusal(F.lit(now).cast("timestamp"), p, ASSUMPTIONS <= set(requests.columns))
    return requests.withColumn("unavailable_reason", reason).withColumn(
        "sector_median",
        F.when(
            F.col("unavailable_reason").isNull(),
            F.try_element_at(F.col("snapshot.sector_medians"), F.col("sector")),
        ),
    )


def to_document(medians: DataFrame, totals: DataFrame) -> DataFrame:
    """Snapshot rows of one generation as the stored document (a few sectors per run)."""
    maps = medians.groupBy("as_of").agg(
        F.map_from_entries(F.collect_list(F.struct("sector", "sector_median")))
        .alias("sector_medians"),
        F.map_from_entries(F.collect_list(F.struct("sector", "sample_count")))
        .alias("sector_sample_counts"),
    )
    body = F.struct(
        "generated_at", "universe_size", "tickers_used", "risk_free_rate", "assumptions",
        "sector_medians", "sector_sample_counts",
    )
    return totals.join(maps, "as_of").select("as_of", F.to_json(body).alias("doc"))


def _whole(v, minimum: int):
    """A whole number from a request value, a number or its text; None if it is none."""
    if isinstance(v, str) and "_" not in v:
        try:
            v = float(v)
        except ValueError:
            return None
    ok = isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) \
        and v == int(v) and v >= minimum
    return int(v) if ok else None


def _page_size(limit, default: int, cap: int) -> int:
    size = _whole(limit, 1)
    return min(size, cap) if size else default


def page(df: DataFrame, limit=None, offset=None, default: int = 50, cap: int = 200):
    """(limit, offset) from request values, numbers or their text; anything invalid falls back.

    An offset is counted off row by row; page_after serves deep pages at the cost of the first.
    """
    return df.offset(_whole(offset, 0) or 0).limit(_page_size(limit, default, cap))


def page_after(df: DataFrame, keys, cursor=None, limit=None, default: int = 50, cap: int = 200):
    """The page behind a cursor, by keys from largest to smallest and nulls last; without a cursor
    the first. The keys together tell rows apart, so no row is repeated or left out between pages,
    also while newer rows are added.

    Rows up to the cursor are left out by a plain predicate that reaches the scan, and each task
    keeps one page, so a deep page costs no more than the first.
    """
    if cursor is not None:
        if len(cursor) != len(keys):
            raise ValueError("a cursor has one value for each key")
        beyond, equal = F.lit(False), F.lit(True)
        for name, value in zip(keys, cursor):
            if value is not None:
                beyond = beyond | (equal & ((F.col(name) < F.lit(value)) | F.col(name).isNull()))
            equal = equal & F.col(name).eqNullSafe(F.lit(value))
        first, value = F.col(keys[0]), cursor[0]
        reach = first.isNull() if value is None else (first <= F.lit(value)) | first.isNull()
        df = df.filter(reach & beyond)
    return df.orderBy(*[F.desc_nulls_last(k) for k in keys]).limit(_page_size(limit, default, cap))


def cursor_of(rows: DataFrame, keys):
    """The keys of a page's last row, for page_after; None for an empty page, which has no next one."""
    last = rows.agg(F.min(F.struct(*keys)).alias("last")).first()["last"]
    return None if last is None else tuple(last)


def allocation(positions: DataFrame, equity: float) -> DataFrame:
    """Weight of each position in percent, largest first; nothing without equity."""
    if equity <= 0:
        return positions.filter(F.lit(False)).withColumn("percentage", F.lit(None).cast("double"))
    return positions.withColumn(
        "percentage", F.col("market_value") / equity * 100
    ).orderBy(F.desc("percentage"), "symbol")
