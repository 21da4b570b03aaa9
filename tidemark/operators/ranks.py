"""Positions in an order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import land

ROW_BITS = 33       # of monotonically_increasing_id, below the partition's number


def numbered(df: DataFrame, group: str, order: list[str], out_col: str = "idx") -> DataFrame:
    """Adds the position of each row in its group by order, from 0. Groups must not be null.

    Rows are sorted by range and numbered in their partition; a count for each partition and group
    moves the numbers on, so a group that holds most rows is spread over tasks.
    """
    by = [F.col(c) for c in (group, *order)]
    rows = land(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(
        "at__", F.monotonically_increasing_id()).withColumn("part__", F.shiftright("at__", ROW_BITS)), "sorted")
    before = Window.partitionBy(group).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(group, "part__").agg(F.count("*").alias("n"), F.min("at__").alias("first"))
    runs = runs.select(group, "part__", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("minus__"))
    return rows.join(runs, [group, "part__"]).withColumn(out_col, F.col("at__") - F.col("minus__")).drop(
        "at__", "part__", "minus__")
