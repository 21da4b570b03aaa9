"""Small column helpers used everywhere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def is_finite(c) -> Column:
    """True only for a present, non-NaN, non-infinite number."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def finite_or_null(c) -> Column:
    c = col(c)
    return F.when(is_finite(c), c)


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def nonzero(c) -> Column:
    """Zero counts as missing."""
    return F.nullif(col(c), F.lit(0.0))


def first_usable(*cols) -> Column:
    """First source that is neither missing nor zero."""
    return F.coalesce(*[nonzero(c) for c in cols])


def ratio(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def clamp(c, low, high) -> Column:
    """least/greatest skip nulls, so a missing value must be guarded."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def positive_whole(c, minimum: int = 1) -> Column:
    """Whole numbers of at least `minimum` as bigint, everything else null."""
    c = col(c)
    ok = is_finite(c) & (c >= minimum) & (c == F.floor(c)) & (c < F.lit(2.0 ** 63))
    return F.when(ok, c).try_cast("bigint")


def first_reason(*checks) -> Column:
    """checks are (condition, code) in order; the first true condition names the reason."""
    return F.coalesce(*[F.when(cond, code if isinstance(code, Column) else F.lit(code)) for cond, code in checks])


def double_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def fence(df, names):
    """Compute the named columns here, once.

    A filter on a computed column is normally rewritten in terms of its inputs, which copies
    long expression chains many times over. Passing the values through a one-row generator
    keeps them as plain attributes; it adds no shuffle.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))
