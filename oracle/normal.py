"""The normal distribution function as a DuckDB expression."""


def normal_cdf_sql(x: str) -> str:
    """Near zero 0.5 + density * (x + x^3/3 + x^5/15 + ...), in the tails density / (x + 1/(x + 2/(x + ...))).

    Both are summed from their far end inwards.
    """
    z = f"least(37e0, abs({x}))"
    density = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()))"
    series = (f"list_reduce([(401 - 2 * i)::DOUBLE for i in generate_series(0, 199)], "
              f"lambda acc, odd: 1e0 + {z} * {z} / odd * acc, 1e0)")
    fraction = f"list_reduce([(300 - i)::DOUBLE for i in generate_series(0, 299)], lambda acc, k: {z} + k / acc, {z})"
    near = f"{density} * {z} * {series}"
    far = f"{density} / {fraction}"
    return (f"(CASE WHEN abs({x}) < 3 THEN 0.5e0 + sign({x}) * {near} "
            f"WHEN {x} < 0 THEN {far} ELSE 1e0 - {far} END)")
