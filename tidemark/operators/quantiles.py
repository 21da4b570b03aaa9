"""Exact grouped quantiles without gathering a group in one task.

A quantile sketch gives each group a bracket for the wanted ranks, and exact counts say which side
of the bracket each rank is on. Only the distinct values of that side are ranked, so the result is
exact whatever the sketch's error is. Equal values collapse before the shuffle, so neither a huge
group nor a heavily repeated value lands whole on one executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import land

ACCURACY = 10_000


def grouped_quantile(df: DataFrame, keys, value: str, q: float, out: str) -> DataFrame:
    """Linear-interpolated quantile and row count per group; null values are ignored.

    df is read three times; land it first when it is expensive to compute. The brackets, one row a
    group, are written, so that their real size decides how they are joined.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    margin = 3.0 / ACCURACY
    ends = [max(q - margin, 0.0), min(q + margin, 1.0)]
    bracket = land(rows.groupBy(*keys).agg(
        F.percentile_approx("__v", ends, ACCURACY).alias("__b"), F.count(F.lit(1)).alias("__n"),
    ).select(*keys, "__n", F.col("__b")[0].alias("__lo"), F.col("__b")[1].alias("__hi")), "brackets")

    def bracketed(table):
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        named = [F.col(f"r.{k}").alias(k) for k in keys]
        return rows.alias("r").join(table.alias("b"), same or F.lit(True)).select(
            *named, "__v", *[f"b.{c}" for c in table.columns if c not in keys])

    v, pos = F.col("__v"), (F.col("__n") - 1) * F.lit(q)
    counts = bracketed(bracket).groupBy(*keys, "__n", "__lo", "__hi").agg(
        F.count_if(v < F.col("__lo")).alias("__below"), F.count_if(v <= F.col("__hi")).alias("__upto"))
    # a rank outside the bracket opens the side it is on
    low_open, high_open = F.floor(pos) < F.col("__below"), F.ceil(pos) >= F.col("__upto")
    counts = land(counts.select(
        *keys, "__n", F.when(~low_open, F.col("__lo")).alias("__from"),
        F.when(~high_open, F.col("__hi")).alias("__to"),
        F.when(low_open, 0).otherwise(F.col("__below")).alias("__before")), "ranges")
    inside = bracketed(counts).filter(
        (F.col("__from").isNull() | (v >= F.col("__from"))) & (F.col("__to").isNull() | (v <= F.col("__to"))))
    counted = inside.groupBy(*keys, "__v").agg(
        F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__n"), F.max("__before").alias("__before"))
    upto = Window.partitionBy(*keys).orderBy("__v")
    ranked = counted.withColumn("__end", F.col("__before") + F.sum("__c").over(upto)).withColumn(
        "__start", F.col("__end") - F.col("__c"))

    def holds(rank):
        return F.max(F.when((rank >= F.col("__start")) & (rank < F.col("__end")), v))

    picked = ranked.groupBy(*keys).agg(
        holds(F.floor(pos)).alias("__a"), holds(F.ceil(pos)).alias("__d"), F.max("__n").alias("__n"))
    frac = pos - F.floor(pos)
    exact = F.when(frac == 0, F.col("__a")).otherwise(
        F.col("__a") + (F.col("__d") - F.col("__a")) * frac)
    return picked.select(*keys, exact.alias(out), F.col("__n").alias("sample_count"))


def grouped_median(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    return grouped_quantile(df, keys, value, 0.5, out)
