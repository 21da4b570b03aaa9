"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import land


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node and root, the smallest node reachable, for each end of an edge (columns a, b).

    Large and small stars take turns until nothing changes, about the logarithm of the longest path
    in rounds. Minima are partial aggregates joined back by key, so the centre of a star is a join
    key that Spark can split, not a gathered group. The driver sees three numbers a round. rows is the
    most edges there are, if that is known.
    """
    edges = land(_pairs(edges), "edges", rows)
    state = _state(edges)
    while True:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = land(_pairs(large), "edges", state[0])
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = land(_pairs(small.unionByName(least.withColumnRenamed("m", "b"))), "edges", state[0])
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _pairs(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mixed), F.sum(mixed % 1_000_003)).first())
