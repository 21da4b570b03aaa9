"""Standard normal distribution in double precision, as plain SQL arithmetic.

Neither engine has an error function. The rational form below is Hart's (1968)
approximation in the arrangement published by West (2005).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Numerator and denominator coefficients, highest power first.
NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
SQRT_2PI = 2.506628274631


def _horner(coefficients, x: str) -> str:
    out = repr(coefficients[0]) if "e" in repr(coefficients[0]) else f"{coefficients[0]!r}e0"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}e0)"
    return out


def normal_cdf_sql(x: str) -> str:
    """SQL text of the distribution function; the same text runs on Spark and DuckDB."""
    z = f"abs({x})"
    near = f"exp(-{z} * {z} / 2e0) * {_horner(NUMERATOR, z)} / {_horner(DENOMINATOR, z)}"
    frac = f"({z} + 0.65e0)"
    for n in (4, 3, 2, 1):
        frac = f"({z} + {n}e0 / {frac})"
    far = f"exp(-{z} * {z} / 2e0) / {frac} / {SQRT_2PI!r}e0"
    tail = (
        f"CASE WHEN {z} > 37e0 THEN 0e0 WHEN {z} < 7.07106781186547e0 THEN {near} ELSE {far} END"
    )
    return f"(CASE WHEN {x} > 0 THEN 1e0 - ({tail}) ELSE ({tail}) END)"


def normal_cdf(column: str) -> Column:
    """Distribution function of a named column."""
    return F.expr(normal_cdf_sql(column))


def normal_density(x: Column, sigma: Column) -> Column:
    import math

    scale = F.lit(1.0) / (sigma * math.sqrt(2 * math.pi))
    return F.when(sigma <= 0, F.lit(0.0)).otherwise(
        scale * F.exp(-(x * x) / (2 * sigma * sigma))
    )
