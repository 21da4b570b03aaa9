"""Tolerance comparison of two result sets, bias, coverage, verdicts and mutation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import ratio
from tidemark.params import METRIC_TOLERANCES, ZERO_TOLERANCE, Tolerances


def _metric_map(values) -> Column:
    flat = []
    for metric, v in values:
        flat += [F.lit(metric), v]
    return F.create_map(*flat)


def melt_metrics(df: DataFrame, columns: dict, keys=("ticker",), out: str = "value") -> DataFrame:
    """One row per metric, with its place in the comparison order."""
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(i).alias("metric_pos"),
                 F.col(columns[m]).cast("double").alias(out))
        for i, m in enumerate(METRIC_TOLERANCES)
    ])
    return df.select(*keys, F.inline(rows))


def compare(produced: DataFrame, expected: DataFrame, keys=("ticker",)) -> DataFrame:
    """Full outer comparison per metric. Rates compare by absolute points, money relatively,
    and an expected zero by an absolute tolerance."""
    key = [*keys, "metric", "metric_pos"]
    j = produced.withColumnRenamed("value", "produced").join(
        expected.withColumnRenamed("value", "expected"), key, "full_outer"
    )
    kind = _metric_map((m, F.lit(k)) for m, (k, _) in METRIC_TOLERANCES.items())[F.col("metric")]
    tol = _metric_map((m, F.lit(t)) for m, (_, t) in METRIC_TOLERANCES.items())[F.col("metric")]
    gap = F.abs(F.col("produced") - F.col("expected"))
    rate, zero = kind == "rate", F.col("expected") == 0
    return j.withColumns({
        "absolute_difference": gap,
        "difference_kind": F.when(rate, "percentage_points").when(zero, "absolute")
        .otherwise("relative"),
        "difference": F.when(rate, gap * 100).when(zero, gap).otherwise(
            ratio(gap, F.abs("expected"))),
        "tolerance": F.when(rate, tol * 100).when(zero, F.lit(ZERO_TOLERANCE)).otherwise(tol),
        "passed": F.coalesce(
            F.when(rate, gap <= tol).when(zero, gap <= ZERO_TOLERANCE)
            .otherwise(ratio(gap, F.abs("expected")) <= tol), F.lit(False)),
    })


def first_divergence(compared: DataFrame, keys=("ticker",)) -> DataFrame:
    failing = F.when(~F.col("passed"), F.col("metric_pos"))
    return compared.groupBy(*keys).agg(
        F.min_by("metric", failing).alias("metric_if_any"), F.min(failing).alias("p"),
        F.count_if(~F.col("passed")).alias("failures"),
    ).select(*keys, F.when(F.col("p").isNotNull(), F.col("metric_if_any"))
             .alias("first_divergence"), "failures")


def directional_bias(compared: DataFrame, noise: float = 0.0) -> DataFrame:
    """A metric is biased when at least two companies differ and all in one direction.

    Differences up to the fraction noise of the expected value count as equal; by default none do.
    """
    gap = F.col("produced") - F.col("expected")
    d = F.when(F.abs(gap) > noise * F.abs("expected"), gap)
    up, down = F.count_if(d > 0), F.count_if(d < 0)
    counts = compared.groupBy("metric").agg(up.alias("above"), down.alias("below"))
    one_sided = (F.col("above") == 0) | (F.col("below") == 0)
    return counts.withColumn("biased", (F.col("above") + F.col("below") >= 2) & one_sided)


def compare_cells(produced: DataFrame, expected: DataFrame, t: Tolerances = Tolerances()):
    """Scalar comparison of melted sensitivity tables; both missing counts as equal."""
    key = ["ticker", "table_no", "pos", "output"]
    j = produced.withColumnRenamed("value", "produced").join(
        expected.withColumnRenamed("value", "expected"), key, "full_outer"
    )
    tol = F.when(F.startswith("output", F.lit("fcf")), t.fcf).when(
        F.col("output") == "intrinsic_value", t.per_share).otherwise(t.value)
    gap = F.abs(F.col("produced") - F.col("expected"))
    missing = F.col("produced").isNull() | F.col("expected").isNull()
    passed = (
        F.when(missing, F.col("produced").isNull() & F.col("expected").isNull())
        .when(F.col("expected") == 0, gap <= t.zero)
        .otherwise(ratio(gap, F.abs("expected")) <= tol)
    )
    kind = F.when(missing, "missing").when(F.col("expected") == 0, "absolute").otherwise("relative")
    return j.withColumns({"kind": kind, "passed": passed})


def monotonic(df: DataFrame, keys, order: str, value: str, rising: str, slack: float = 1e-9):
    """Whether the values never step against the named direction (a boolean column)."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.filter(F.col(value).isNotNull()).withColumn("step", F.col(value) - F.lag(value).over(w))
    up, down = F.col("step") >= -slack, F.col("step") <= slack
    ok = F.when(F.col(rising), up).otherwise(down)
    return rows.groupBy(*keys).agg(F.bool_and(F.coalesce(ok, F.lit(True))).alias("monotonic"))


def coverage(cells: DataFrame) -> DataFrame:
    """Scenarios, outputs and scalars compared per company and table."""
    return cells.groupBy("ticker", "table_no").agg(
        F.count_distinct("pos").alias("scenarios"), F.count_distinct("output").alias("outputs"),
        F.count(F.lit(1)).alias("scalars"), F.bool_and("passed").alias("all_passed"),
    )


def verdict(base: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: both parts pass, and how many companies fail each."""
    def part(df, name):
        per = df.groupBy("ticker").agg(F.bool_and("passed").alias("ok"))
        return per.agg(
            F.bool_and("ok").alias(f"{name}_pass"), F.count_if(~F.col("ok")).alias(f"{name}_failing")
        )

    other = part(cells, "sensitivity")
    j = part(base, "base").withColumns({c: other.select(c).scalar() for c in other.columns})
    return j.withColumn("overall_pass", F.col("base_pass") & F.col("sensitivity_pass"))


def failing_companies(compared: DataFrame) -> DataFrame:
    return compared.groupBy("ticker").agg(F.bool_and("passed").alias("ok")).filter("not ok").select(
        "ticker"
    )


DOWNSTREAM = ("terminal_value", "pv_terminal_value", "enterprise_value", "equity_value",
              "intrinsic_value")


def inject_terminal_error(valued: DataFrame, years: int = 5) -> DataFrame:
    """Divide by the discount rate instead of the spread and carry the error downstream."""
    debt, cash = F.coalesce("total_debt", F.lit(0.0)), F.coalesce("cash", F.lit(0.0))
    bad = valued.withColumn(
        "bad_terminal_value",
        ratio(F.col("final_fcf") * (1 + F.col("terminal_growth")), "wacc"),
    ).withColumn(
        "bad_pv_terminal_value", F.col("bad_terminal_value") / F.pow(1 + F.col("wacc"), float(years))
    ).withColumn("bad_enterprise_value", F.col("pv_explicit_fcf") + F.col("bad_pv_terminal_value"))
    bad = bad.withColumn("bad_equity_value", F.col("bad_enterprise_value") - debt + cash)
    return bad.withColumn("bad_intrinsic_value", ratio("bad_equity_value", "shares"))


def mutation_check(valued: DataFrame) -> DataFrame:
    """Per company and metric: does the injected error leave the tolerance?"""
    tol = {"intrinsic_value": METRIC_TOLERANCES["intrinsic_value_per_share"][1]}
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.lit(i).alias("metric_pos"),
            ratio(F.abs(F.col(m) - F.col(f"bad_{m}")), F.abs(m)).alias("difference"),
            F.lit(tol.get(m) or METRIC_TOLERANCES[m][1]).alias("tolerance"),
        )
        for i, m in enumerate(DOWNSTREAM)
    ])
    bad = inject_terminal_error(valued.filter("dcf_error is null"))
    return bad.select("ticker", F.inline(rows)).withColumn(
        "detected", F.coalesce(F.col("difference") > F.col("tolerance"), F.lit(False))
    )


def calendar_irregularity(statements: DataFrame, slack_years: float = 0.05) -> DataFrame:
    """Elapsed years by calendar against the number of reported periods less one."""
    own = statements.filter("statement = 'income'").groupBy("ticker").agg(
        F.min("period_end").alias("first"), F.max("period_end").alias("last"),
        F.count_distinct("period_end").alias("periods"),
    )
    actual = F.datediff("last", "first") / 365.25
    return own.select(
        "ticker", "periods", actual.alias("years_actual"), (F.col("periods") - 1.0).alias("years_naive"),
        (F.abs(actual - (F.col("periods") - 1)) > slack_years).alias("irregular"),
    )
