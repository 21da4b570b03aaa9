"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments so that a bucket of a segment holds about four codes. Search radii grow
by one bit in one segment after the other: once the first i segments are probed up to radius r and
the others up to r - 1, every code within segments * r + i - 1 bits is known, since a code further
off in all of them has at least one bit more. Only queries whose k-th neighbour is not yet within
that distance go on.

Probes are no rows, as their number grows steeply with the radius. The buckets of a segment that agree
in its high bits are held together in blocks, and rows say only which queries visit which high bits, at
which radius in the low bits. A task takes one block of codes and one of queries, flips the low bits
and looks the buckets up.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import land

SEED = 11
STEP_PROBES = 256       # probes of a query before it is asked whether it is done
HELD = 1 << 15          # codes in a block, about
ASKED = 1 << 10         # queries in a block, about
CANDIDATES = 1 << 20    # codes that a task compares at a time


def codes(vectors: DataFrame, vec_col: str = "embedding", out_col: str = "code") -> DataFrame:
    """Adds a 64-bit code: the signs of fixed random projections, 0 counting as negative.

    Null vectors have no code; null and non-finite elements count as 0. Vectors of different lengths
    are projected by the leading rows of one matrix.
    """
    @F.arrow_udf("long")
    def signs(arrays: pa.Array) -> pa.Array:
        lengths = [len(a) if a.is_valid else 0 for a in arrays]
        rng = np.random.Generator(np.random.PCG64(SEED))
        planes = rng.standard_normal((max(lengths, default=0), 64))
        dense = np.zeros((len(arrays), len(planes)))
        for i, a in enumerate(arrays):
            if lengths[i]:
                dense[i, :lengths[i]] = a.values.to_numpy(zero_copy_only=False)
        bits = np.nan_to_num(dense, nan=0, posinf=0, neginf=0) @ planes > 0
        out = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.int64)
        return pa.array(out, pa.int64(), mask=np.array([not a.is_valid for a in arrays], bool))

    return vectors.withColumn(out_col, signs(F.col(vec_col)))


def _segments(n: int) -> list[tuple[int, int]]:
    """First bit and width of each segment for n codes: about four codes to a bucket.

    Buckets of one code would ask for far more probes than there are codes to find.
    """
    parts = math.ceil(64 / max(4, min(20, round(math.log2(max(2, n / 4))))))
    edges = [64 * i // parts for i in range(parts + 1)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:]))))


def _steps(widths: list[int]) -> list[tuple[int, list[int]]]:
    """Radius and segments of each step: segments one after the other, few probes in one go."""
    steps = []
    for radius in range(max(widths) + 1):
        size = STEP_PROBES
        for i, width in enumerate(widths):
            size += math.comb(width, radius)
            if i == 0 or size > STEP_PROBES:
                steps.append((radius, []))
                size = math.comb(width, radius)
            steps[-1][1].append(i)
    return steps


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(first: int, width: int, bits: int) -> list[int]:
    """All ways to set so many of the bits from the first on."""
    return [sum(1 << first + b for b in c) for c in combinations(range(width), bits)]


def _blocks(rows: DataFrame, parts: DataFrame, size: int, block: str, code: str) -> DataFrame:
    """Adds the number of a row's block among those of its segment and value; parts counts the latter's rows."""
    return rows.join(parts, ["segment", "value"]).withColumn(
        block, F.pmod(F.xxhash64(code), F.ceil(F.col("rows") / size)))


def _index(known: DataFrame, cuts: list[tuple[int, int]], high: int) -> DataFrame:
    """Blocks of codes, by first id, for each segment and each value of its high bits."""
    tops = [F.col("code").bitwiseAND(F.lit(_top(cut, high)).cast("long")) for cut in cuts]
    spread = known.select("*", F.explode(F.array(*[
        F.struct(F.lit(i).alias("segment"), top.alias("value")) for i, top in enumerate(tops)
    ])).alias("s")).select("first", "code", "members", "s.*")
    parts = land(spread.groupBy("segment", "value").agg(F.count("*").alias("rows")), "code-blocks", len(cuts) << high)
    return land(_blocks(spread, parts, HELD, "block", "code").groupBy("segment", "value", "block").agg(
        F.array_sort(F.collect_list(F.struct("first", "code", "members"))).alias("held")), "index")


def _top(cut: tuple[int, int], high: int) -> int:
    """Mask of the high bits of a segment."""
    a, w = cut
    return _signed((1 << a + w) - (1 << a + max(0, w - high)))


def visits(asked: DataFrame, cuts: list[tuple[int, int]], high: int, segments: list[int], radius: int) -> DataFrame:
    """Each query with each value of high bits that has buckets at the radius, and the radius left for the low bits."""
    out = None
    for i in segments:
        a, w = cuts[i]
        low = max(0, w - high)
        flips = [x for n in range(max(0, radius - low), min(radius, w - low) + 1) for x in _flips(a + low, w - low, n)]
        if not flips:
            continue
        some = asked.select("*", F.lit(i).alias("segment"),
                            F.explode(F.lit(np.array([_signed(x) for x in flips], np.int64))).alias("value"))
        some = some.withColumn("radius", F.lit(radius) - F.bit_count("value")).withColumn(
            "value", F.col("value").bitwiseXOR(F.col("q").bitwiseAND(F.lit(_top(cuts[i], high)).cast("long"))))
        out = some if out is None else out.unionByName(some)
    return out


def _search(cuts: list[tuple[int, int]], high: int, radius: int, k: int):
    """Of each block of codes the k nearest of each query that differ by the radius in their closest segment."""
    masks = [np.uint64(((1 << w) - 1) << a) for a, w in cuts]

    def search(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield from found(*(batch.column(c)[row] for c in ("segment", "asked", "held")))

    def found(segment, asked, held):
        i, asked, held = segment.as_py(), asked.values, held.values
        a, w = cuts[i]
        low = max(0, w - high)
        codes = held.field("code").to_numpy().view(np.uint64)
        below = np.uint64((1 << low) - 1)
        value = (codes >> np.uint64(a) & below).astype(np.int64)
        order = np.argsort(value, kind="stable")
        starts = np.searchsorted(value[order], np.arange((1 << low) + 1))
        queries = asked.field("q").to_numpy().view(np.uint64)
        most, left = asked.field("most").to_numpy(), asked.field("radius").to_numpy()
        for r in np.unique(left).tolist():
            flips = np.array(_flips(0, low, r), np.int64)
            some = np.flatnonzero(left == r)
            step = max(1, CANDIDATES // max(len(codes), len(flips)))
            for at in range(0, len(some), step):
                part = some[at:at + step]
                q = queries[part]
                probes = (q >> np.uint64(a) & below).astype(np.int64)[:, None] ^ flips[None, :]
                begin, n = starts[probes].ravel(), (starts[probes + 1] - starts[probes]).ravel()
                ends = np.cumsum(n)
                near = order[np.repeat(begin - ends + n, n) + np.arange(n.sum())]
                by = np.repeat(np.arange(len(part)), n.reshape(probes.shape).sum(axis=1))
                off = q[by] ^ codes[near]
                distance = np.bitwise_count(off)
                keep = distance <= most[part][by]
                # each code comes up once: by its closest segment, the first of several
                for j, mask in enumerate(masks):
                    if j != i:
                        keep[keep] = np.bitwise_count(off[keep] & mask) >= radius + (j < i)
                near, by, distance = near[keep], by[keep], distance[keep]
                rank = np.lexsort((near, distance, by))     # held is by first id
                near, by, distance = near[rank], by[rank], distance[rank]
                best = np.arange(len(by)) - np.searchsorted(by, by) < k
                hits = held.take(pa.array(near[best]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q[by[best]].view(np.int64)), hits.field("code"), hits.field("first"),
                     hits.field("members"), pa.array(distance[best].astype(np.int32))],
                    ["q", "code", "first", "members", "distance"])

    return search


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
          code_col: str = "code") -> DataFrame:
    """query_id, rank, neighbour_id and distance: the k nearest rows of each query, itself left out.

    Nearest means fewest differing bits, then smallest id. Rows and queries without id or code are
    left out; repeated ids with one code count once. With fewer than k other rows all are returned.
    """
    def clean(df):
        return df.where(F.col(id_col).isNotNull() & F.col(code_col).isNotNull()).select(
            F.col(id_col).alias("id"), F.col(code_col).alias("code")).distinct()

    rows, queries = land(clean(rows), "rows"), land(clean(queries), "queries")
    by_code = Window.partitionBy("code").orderBy("id")
    members = rows.withColumn("n", F.row_number().over(by_code)).where(f"n <= {k + 1}").select("id", "code")
    known = land(rows.groupBy("code").agg(F.min("id").alias("first"), F.count("*").alias("members")), "codes")
    total, n = rows.count(), known.count()
    cuts = _segments(n)
    high = min(max(w for _, w in cuts), (n // HELD).bit_length())
    index = _index(known, cuts, high)
    schema = f"q long, code long, first {known.schema['first'].dataType.simpleString()}, members long, distance int"
    open_, best, closed = queries.select(F.col("code").alias("q"), F.lit(64).alias("most")).distinct(), None, []
    near = Window.partitionBy("q").orderBy("distance", "first")
    for radius, segments in _steps([w for _, w in cuts]):
        asked = visits(open_, cuts, high, segments, radius)
        if asked is None:
            continue
        parts = land(asked.groupBy("segment", "value").agg(F.count("*").alias("rows")), "query-blocks",
                     len(segments) << high)
        asked = _blocks(asked, parts, ASKED, "ask", "q").groupBy("segment", "value", "ask").agg(
            F.collect_list(F.struct("q", "most", "radius")).alias("asked"))
        numbers = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows") / ASKED) - 1)
        held = index.where(F.col("segment").isin(segments)).join(parts, ["segment", "value"]).select(
            "segment", "value", "held", F.explode(numbers).alias("ask"))
        # neither side may be broadcast: each block of queries with each of codes is work of its own
        found = held.join(asked.hint("shuffle_hash"), ["segment", "value", "ask"]).select(
            "segment", "asked", "held").mapInArrow(_search(cuts, high, radius, k + 1), schema)
        if best is not None:
            found = found.unionByName(best.join(open_, "q", "left_semi"))
        best = land(found.withColumn("n", F.row_number().over(near)).where(f"n <= {k + 1}").drop("n"), "nearest")
        covered = len(cuts) * radius + segments[-1]
        state = best.groupBy("q").agg(
            F.sum(F.when(F.col("distance") <= covered, F.col("members")).otherwise(0)).alias("n"),
            F.when(F.sum("members") > k, F.max("distance")).alias("worst"))
        left = land(open_.join(state, "q", "left").where(F.coalesce("n", F.lit(0)) < min(k + 1, total)).select(
            "q", F.coalesce("worst", "most").alias("most")), "open-queries")
        closed.append(best.join(left, "q", "left_anti"))
        open_ = left
        if open_.isEmpty():
            break
    nearest = closed[0]
    for more in closed[1:]:
        nearest = nearest.unionByName(more)
    hits = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(
        nearest.select("q", "code", "distance"), "q").join(members, "code").where("id != query_id")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select(
        "query_id", "rank", F.col("id").alias("neighbour_id"), "distance")
