"""Named queries over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import fixtures

QUERIES: dict = {}


class Tables:
    """Fixture tables by attribute, derived lazily from one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def raw(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = getattr(fixtures, name)(self.spark, self.sf_dir)
        return self._made[name]


def rounded(df: DataFrame, money=()) -> DataFrame:
    """Floating results depend on summation order in the last bits, so they are rounded."""
    return df.select(*[
        (F.round(c, 2 if c in money else 6) + 0.0).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes
    ])


def query(money=()):
    def register(fn):
        def run(spark, sf_dir):
            return rounded(fn(Tables(spark, sf_dir)), money)

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        return fn

    return register
