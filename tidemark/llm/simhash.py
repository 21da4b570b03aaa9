"""SimHash near-duplicates by a self-join of binary tries.

Codes within a budget of k differing bits agree on one of any k + 1 blocks, so the trie over all
codes falls into subtries of codes with an equal block. Inside a subtrie, pairs of nodes are walked
together; a pair whose paths differ in more bits than the budget is cut off with all below it. A
subtrie that is too large for a task is cut again by blocks of its free bits: codes are distinct, so
this ends. Tasks hand on a spanning forest of the links they find, never all pairs of a group.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.components import components
from tidemark.session import land

SEED = 42
SUBTRIE_CODES = 20_000      # codes that a task holds at once
LEAF_PAIRS = 4_096          # code pairs compared at once at the end of a walk
MOST_PAIRS = 1_000_000
# Fixed odd multipliers that turn one hash into several.
MIX = np.array([1] + [int(xxhash.xxh64_intdigest(bytes([i]))) | 1 for i in range(1, 64)], np.uint64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of size words; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode().lower().split()       # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) > size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64)


def signature(hashes: np.ndarray, tables: int = 1) -> np.ndarray:
    """A 64-bit code for each table: bits set in over half the hashes."""
    counts = np.zeros((tables, 64), np.int64)
    for at in range(0, len(hashes), 4_096):
        part = hashes[at:at + 4_096, None] * MIX[:tables]
        if tables > 1:
            part[:, 1:] ^= part[:, 1:] >> np.uint64(32)
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64).reshape(tables, 64)
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(df: DataFrame, size: int = 3, text_col: str = "text", out_col: str = "code") -> DataFrame:
    """Adds the SimHash of each whole text as a signed 64-bit number; a column out_col is replaced.

    Texts without words, null ones too, have code 0.
    """
    @F.arrow_udf("long")
    def codes(texts: pa.Array) -> pa.Array:
        out = [signature(shingle_hashes(x.as_py(), size))[0] for x in texts]
        return pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())

    return df.withColumn(out_col, codes(F.col(text_col)))


def node_pairs(codes: np.ndarray, budget: int):
    """Positions of codes (sorted, distinct) that differ in at most budget bits, in arrays of pairs."""
    stack = [(0, len(codes), 0, len(codes), 63, 0)]
    while stack:
        a, a_end, b, b_end, bit, differ = stack.pop()
        if differ > budget or a == a_end or b == b_end or (a == b and a_end - a < 2):
            continue
        if (a_end - a) * (b_end - b) <= LEAF_PAIRS or bit < 0:
            rows = max(1, MOST_PAIRS // (b_end - b))
            for at in range(a, a_end, rows):
                off = np.bitwise_count(codes[at:min(a_end, at + rows), None] ^ codes[None, b:b_end])
                left, right = np.nonzero(off <= budget)
                left, right = left + at, right + b
                keep = left < right
                yield left[keep], right[keep]
            continue
        half = np.uint64(1 << bit)

        def middle(lo, hi):
            top = codes[lo] & ~(half | (half - np.uint64(1))) | half
            return lo + int(np.searchsorted(codes[lo:hi], top))

        x, y = middle(a, a_end), middle(b, b_end)
        stack += [(a, x, b, y, bit - 1, differ), (x, a_end, y, b_end, bit - 1, differ),
                  (a, x, y, b_end, bit - 1, differ + 1)]
        if a != b:
            stack.append((x, a_end, b, y, bit - 1, differ + 1))


def forest(codes: np.ndarray, nodes: np.ndarray, budget: int):
    """Node pairs that span the links between distinct codes."""
    order = np.argsort(codes, kind="stable")
    codes, nodes = codes[order], nodes[order]
    parent = list(range(len(codes)))
    label = np.arange(len(codes))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for left, right in node_pairs(codes, budget):
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
        if not len(left):
            continue
        for i, j in zip(label[left].tolist(), label[right].tolist()):
            i, j = find(i), find(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
        names, place = np.unique(label, return_inverse=True)
        label = np.array([find(i) for i in names.tolist()])[place]
    linked = label != np.arange(len(codes))
    return nodes[linked], nodes[label[linked]]


def _cut(free: int, blocks: int) -> list[int]:
    """Masks of blocks of about equal numbers of the set bits of free."""
    bits = [i for i in range(64) if free >> i & 1]
    edges = [len(bits) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(codes: DataFrame, budget: int) -> DataFrame:
    """Edges a, b that span all links between nodes whose codes differ in at most budget bits.

    codes has columns node, table and code. Nodes of one table are compared; node and code must be
    one-to-one in a table, so cutting a subtrie ends with one of few codes.
    """
    rows, done = codes.withColumn("mask", F.lit(0).cast("long")), None
    masks = {0}
    while masks:
        cuts = {m: [_signed(m | x) for x in _cut(~m & (1 << 64) - 1, budget + 1)] for m in masks}
        spread = F.create_map(*[x for m, c in cuts.items() for x in (
            F.lit(_signed(m)), F.array(*map(F.lit, c)).cast("array<long>"))])
        rows = rows.withColumn("mask", F.explode(F.element_at(spread, F.col("mask"))))
        rows = rows.withColumn("value", F.col("code").bitwiseAND(F.col("mask")))
        counts = rows.groupBy("table", "mask", "value").agg(F.count("*").alias("n"))
        free = F.lit(64) - F.bit_count("mask")
        large = (F.col("n") > SUBTRIE_CODES) & (free > max(budget, 2))
        large = land(counts.where(large).drop("n"), "large-subtries")
        key = ["table", "mask", "value"]
        masks = {r.mask & (1 << 64) - 1 for r in large.select("mask").distinct().collect()}
        small = rows.join(large, key, "left_anti") if masks else rows
        done = small if done is None else done.unionByName(small)
        rows = rows.join(large, key, "left_semi").drop("value")

    def spans(batches):
        held, at = [], None

        def edges():
            codes = np.array([r["code"] for r in held], np.int64).view(np.uint64)
            nodes = np.array([r["node"] for r in held], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in forest(codes, nodes, budget)], ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                key = row["table"], row["mask"], row["value"]
                if key != at:
                    if len(held) > 1:
                        yield edges()
                    held, at = [], key
                held.append(row)
        if len(held) > 1:
            yield edges()

    key = ["table", "mask", "value"]
    return done.repartition(*key).sortWithinPartitions(*key).mapInArrow(spans, "a long, b long")


def groups(df: DataFrame, budget: int = 2, id_col: str = "doc_id", code_col: str = "code") -> DataFrame:
    """doc_id, code and component_id of each row: the smallest id that links reach from it.

    Rows of one code are linked; codes link at budget or fewer differing bits. Null ids never name a
    component, unless it has no other. Repeated rows and extra columns do no harm.
    """
    docs = land(df.select(F.col(id_col).alias("doc_id"), F.col(code_col).alias("code")), "codes")
    codes = land(docs.groupBy("code").agg(F.min("doc_id").alias("first_id")), "distinct-codes")
    edges = links(codes.select(
        F.col("code").alias("node"), F.lit(0).alias("table"), "code"), budget)
    roots = components(edges)
    codes = codes.join(roots.withColumnRenamed("node", "code"), "code", "left") \
        .withColumn("root", F.coalesce("root", "code"))
    names = codes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = land(codes.join(names, "root").select("code", "component_id"), "named-codes")
    return docs.join(named, "code").select("doc_id", "code", "component_id")
