"""Session and durable-table helpers."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_A_FILE = 10_000        # of landed tables whose number of rows is known beforehand


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only in local mode, where none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def land(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df once to the shared folder and continue from the table.

    Used where one result feeds several branches: the branches then read files that
    survive a lost executor, with column pruning and real size statistics.
    rows: about how many there are at most, for tables of a few numbers a row made by light last
    stages: few of them go to few files, however many partitions the shuffle before has.
    """
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / ROWS_A_FILE)))
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
