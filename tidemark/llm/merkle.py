"""Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Each group's rows are leaves of a tree of runs of eight; the groups' roots are the leaves of a last
tree. A task holds one aligned block: a subtree of a few levels, laid out by splitting its height in
half again and again, so that a node's place is arithmetic on its level and number. Block roots are
the leaves of the next level of blocks, until a group has one block. Siblings are read from the same
places on the way down, and a proof is handed from a block to the blocks below it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import land

ARITY = 8
HEIGHT = 4                  # levels above the leaves of a block
DIGEST = 32
ROW_BITS = 33               # of monotonically_increasing_id, below the partition's number

PROOF = "array<struct<before:string,after:string>>"
BLOCK_SCHEMA = "grp string, block long, n int, many boolean, nodes binary, ids array<long>, seen array<string>"
PROVED = f"grp string, subroot string, id long, seen string, digest string, proof {PROOF}"


def size_of(height: int) -> int:
    """Nodes of a full tree with height levels above its leaves."""
    return (ARITY ** (height + 1) - 1) // (ARITY - 1)


def address(height: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places of the nodes at a depth, by their numbers from the left, in a tree of height levels
    above its leaves.

    The upper half of the levels is a tree of its own that comes first; each tree that hangs below it
    follows as one piece. Both are laid out the same way.
    """
    if height == 0:
        return np.zeros_like(number)
    upper = (height + 1) // 2           # levels of the tree on top
    lower = height - upper              # height of those below it
    if depth < upper:
        return address(upper - 1, depth, number)
    under = ARITY ** (depth - upper)
    return size_of(upper - 1) + number // under * size_of(lower) + address(lower, depth - upper, number % under)


def levels_of(n: int, many: bool, height: int) -> list[int]:
    """Nodes at each level of a block with n leaves, leaves first; a group's only block ends at one."""
    sizes = [n]
    while len(sizes) <= height and (many or sizes[-1] > 1):
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def places(n: int, many: bool, height: int) -> list[np.ndarray]:
    """Where the nodes of each level of a block are, leaves first."""
    sizes = levels_of(n, many, height)
    return [address(len(sizes) - 1, len(sizes) - 1 - up, np.arange(k)) for up, k in enumerate(sizes)]


def build_block(digests: list[bytes], many: bool, height: int) -> bytes:
    """The block over these leaves: all nodes' digests in their places, the root first."""
    at = places(len(digests), many, height)
    nodes = np.zeros((size_of(len(at) - 1), DIGEST), np.uint8)
    nodes[at[0]] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST)
    for below, here in zip(at, at[1:]):
        text = nodes[below].tobytes().hex()
        width = 2 * DIGEST * ARITY
        made = [hashlib.sha256(text[i:i + width].encode()).digest() for i in range(0, len(text), width)]
        nodes[here] = np.frombuffer(b"".join(made), np.uint8).reshape(-1, DIGEST)
    return nodes.tobytes()


def paths(nodes: bytes, n: int, many: bool, height: int) -> list[list[tuple[str, str]]]:
    """For each leaf of a block the siblings before and after it, level by level up to the block's root."""
    nodes = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    out, span = [[] for _ in range(n)], 1
    for here in places(n, many, height)[:-1]:
        names = nodes[here].tobytes().hex()
        names = [names[i:i + 2 * DIGEST] for i in range(0, len(names), 2 * DIGEST)]
        for i in range(len(names)):
            first = i // ARITY * ARITY
            pair = "".join(names[first:i]), "".join(names[i + 1:first + ARITY])
            for leaf in range(i * span, min(n, (i + 1) * span)):
                out[leaf].append(pair)
        span *= ARITY
    return out


def field(c: Column) -> Column:
    """A value as leaves hold it: '-' for null, else its length in UTF-8 bytes, ':' and the value."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """Lower-case hex sha256 of the fields of a row."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (grp, ...) with rank in its group by order, and total, the group's rows.

    Rows are sorted by range and numbered in their partition; a count for each partition and group
    moves the numbers on, so no group is gathered. Rows equal in order keep some fixed order.
    """
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [F.asc_nulls_first(c) for c in ["grp", *order, "tie"]]
    rows = land(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn(
        "at", F.monotonically_increasing_id()), "sorted-leaves")
    part = F.shiftright("at", ROW_BITS).alias("part")
    runs = rows.groupBy("grp", part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("grp")       # a row for each partition that has the group
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = land(runs.select(
        "grp", "part", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("minus"),
        F.sum("n").over(whole).alias("total")), "sorted-runs")
    return rows.withColumn("part", part).join(runs, ["grp", "part"]).withColumn(
        "rank", F.col("at") - F.col("minus")).drop("at", "part", "minus")


def _blocks(leaves: DataFrame, height: int) -> DataFrame:
    """Blocks over leaves with columns grp, rank, total, digest (binary), id and seen."""
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        many = table["total"][0].as_py() > ARITY ** height
        nodes = build_block(table["digest"].to_pylist(), many, height)
        return pa.table({
            "grp": table["grp"].slice(0, 1), "block": table["block"].slice(0, 1),
            "n": pa.array([len(table)], pa.int32()), "many": [many], "nodes": pa.array([nodes], pa.binary()),
            "ids": pa.array([table["id"].to_pylist()], pa.list_(pa.int64())),
            "seen": pa.array([table["seen"].to_pylist()], pa.list_(pa.string()))})

    block = F.call_function("div", "rank", F.lit(ARITY ** height)).alias("block")
    return land(leaves.select("grp", block, "rank", "total", "digest", "id", "seen").groupBy(
        "grp", "block").applyInArrow(build, BLOCK_SCHEMA), "blocks")


def _tree(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Tables of blocks, the lowest first; each group has one block in the last it occurs in."""
    made = [_blocks(leaves, height)]
    while True:
        blocks = made[-1].where("many")
        if blocks.isEmpty():
            return made
        counts = blocks.groupBy("grp").agg(F.count("*").alias("total"))
        made.append(_blocks(blocks.join(counts, "grp").select(
            "grp", F.col("block").alias("rank"), "total", F.substring("nodes", 1, DIGEST).alias("digest"),
            F.col("block").alias("id"), F.lit(None).cast("string").alias("seen")), height))


def _down(tree: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """grp, subroot, id, seen, digest and proof of each leaf of the lowest blocks.

    above has grp, its subroot and the proof of that. A block's proof goes to the blocks below it.
    """
    def prove(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, path = row["n"], paths(row["nodes"], row["n"], row["many"], height)
                at = places(n, row["many"], height)[0]
                text = np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST)[at].tobytes().hex()
                rest = [(p["before"], p["after"]) for p in row["proof"]]
                steps = [p for inner in path for p in (*inner, *rest)]
                ends = np.concatenate([[0], np.cumsum([len(p) + len(rest) for p in path])]).astype(np.int32)
                proofs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(
                    [pa.array([p[i] for p in steps], pa.string()) for i in range(2)], ["before", "after"]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["grp"]] * n, pa.string()), pa.array([row["subroot"]] * n, pa.string()),
                    pa.array(row["ids"], pa.int64()), pa.array(row["seen"], pa.string()),
                    pa.array([text[i:i + 2 * DIGEST] for i in range(0, len(text), 2 * DIGEST)], pa.string()),
                    proofs], ["grp", "subroot", "id", "seen", "digest", "proof"])

    proved = None
    for blocks in reversed(tree):
        tops = blocks.where("not many").join(above, "grp")
        if proved is not None:
            over = land(proved.select("grp", "subroot", F.col("id").alias("block"), "proof"), "block-proofs")
            tops = tops.unionByName(blocks.where("many").join(over, ["grp", "block"]))
        proved = tops.select("grp", "subroot", "n", "many", "nodes", "ids", "seen", "proof").mapInArrow(prove, PROVED)
    return proved


def _roots(tree: list[DataFrame]) -> DataFrame:
    """grp and digest (binary) of each group's root."""
    out = None
    for blocks in tree:
        tops = blocks.where("not many").select("grp", F.substring("nodes", 1, DIGEST).alias("digest"))
        out = tops if out is None else out.unionByName(tops)
    return out


def manifest(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """grp, id, leaf, seen, subroot, root and proof of each row.

    rows has columns grp (string), id (long), leaf (hex digest) and seen, anything a row carries along,
    such as the digest it has now. Leaves ascend by id in each grp, null ids first, by digest where ids
    are equal; blocks hold eight to the power height of them. Every run of eight, or what is left of one, becomes the sha256 of its digests as hex
    text, until one is left, the subroot; a lone leaf is its own. Subroots ordered by grp, null first,
    give the root likewise. proof has a step a level: the text of the siblings before and after the
    node. Repeated rows are leaves of their own; other columns, of any name, are not read; no rows give
    no rows. The driver sees the root.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit(""))       # null sorts first
    tree = _tree(_ranked(rows.select(
        key.alias("grp"), "id", F.unhex("leaf").alias("digest"), "seen"), ["id", "digest"]), height)
    subroots = _roots(tree).select(F.lit("").alias("grp"), F.col("grp").alias("seen"), "digest")
    upper = _tree(_ranked(subroots, ["seen"]).withColumn("id", F.col("rank")), height)
    root = _roots(upper).first()
    root = root.digest.hex() if root else None
    top = upper[0].select("grp", F.lit(root).alias("subroot"), F.array().cast(PROOF).alias("proof")).distinct()
    above = land(_down(upper, top, height).select(
        F.col("seen").alias("grp"), F.col("digest").alias("subroot"), "proof"), "subroots")
    return _down(tree, above, height).select(
        F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).alias("grp"),
        "id", F.col("digest").alias("leaf"), "seen", "subroot", F.lit(root).cast("string").alias("root"), "proof")


def fold(node: Column, proof: Column) -> Column:
    """The root that a digest and a proof lead to."""
    return F.aggregate(proof, node, lambda x, step: F.sha2(F.concat(step["before"], x, step["after"]), 256))
