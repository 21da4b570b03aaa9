"""Near-duplicates at a Jaccard similarity of shingles, by SimHash groups and bands of min-hashes.

The SimHash codes of the texts go through the trie self-join of simhash.py, and each group it makes is a
bucket. Those codes agree only for very alike texts, so texts with an equal band of min-hashes fall into
one bucket as well: the bands add what the codes leave out. A bucket is solved when its texts are one component;
until then it links its members, in turns, to one of them. Bands come in a few rounds: what the first
round has tied together needs no comparison in the next, so a large group is compared about once, not
once a band. Only unsolved buckets are carried on, and only what a turn has linked anew is contracted.
A sketch of two bits a min-hash stands beside each member and rules out unlike pairs before any text
is fetched; what is left is verified by the shingles themselves. In buckets that no turn solves each
component is compared with the others, in a join that lets only alike pairs out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components
from tidemark.llm.simhash import shingle_hashes
from tidemark.session import land

BAND_HASHES = 5             # min-hashes of a band
MISSED = 1e-4               # of pairs just at the similarity, in no bucket together
ROUNDS = (1, 3, 8)          # bands of the first rounds: 0 and the groups, then 1 and 2, then 3 to 7; the rest last
TURNS = 2                   # most turns in a round, before what is left waits for the next
SKETCHED, SKETCH_LONGS = 128, 4
CACHED_HASHES = 4_000_000
SPREAD = 5.0                # standard deviations that a sketch may be off


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes, in order."""
    return np.unique(shingle_hashes(text, size))


class Sets:
    """The shingle sets of the texts met last: the pairs of a group have texts in common."""

    def __init__(self, size: int):
        self.size, self.sets, self.room = size, {}, CACHED_HASHES

    def __call__(self, text: str) -> np.ndarray:
        if text not in self.sets:
            made = shingle_set(text, self.size)
            if len(made) > self.room:
                self.sets, self.room = {}, CACHED_HASHES
            self.room -= len(made)
            self.sets[text] = made
        return self.sets[text]


def band_hashes(similarity: float) -> np.ndarray:
    """Multipliers of the min-hashes, a row a band: all bands differ for at most MISSED of the pairs
    of this Jaccard similarity."""
    bands = math.ceil(math.log(MISSED) / math.log1p(-similarity ** BAND_HASHES)) if similarity < 1 else 1
    return np.array([int(xxhash.xxh64_intdigest(i.to_bytes(4, "little"))) | 1
                     for i in range(bands * BAND_HASHES)], np.uint64).reshape(bands, BAND_HASHES)


def least_hashes(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The min-hashes of a set, in the shape of by."""
    least = np.full(by.size, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1_024):
        np.minimum(least, (by.reshape(-1, 1) * hashes[None, at:at + 1_024]).min(1), out=least)
    return least.reshape(by.shape)


def sketch_of(least: np.ndarray) -> np.ndarray:
    """Two bits of each of the first SKETCHED min-hashes, as SKETCH_LONGS numbers."""
    two = (least.ravel()[:SKETCHED] >> np.uint64(16)).astype(np.uint8) & 3
    bits = np.zeros(64 * SKETCH_LONGS, np.uint8)
    bits[:2 * len(two):2], bits[1:2 * len(two):2] = two & 1, two >> 1
    return np.packbits(bits).view(np.int64)


def sketch_cut(hashes: int, similarity: float) -> int:
    """Differing sketch bits beyond which a pair of this similarity is SPREAD deviations away."""
    n, off = min(hashes, SKETCHED), 1 - similarity
    return math.floor(n * off + SPREAD * math.sqrt(n * off * (1.5 - off)))


def _alike(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Rows of pairs whose nodes a, b have sets of shingles with this Jaccard similarity at least."""
    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        out, of = [], Sets(size)
        for x, y in zip(left, right):
            x, y = of(x.as_py()), of(y.as_py())
            low, high = sorted((len(x), len(y)))
            both = len(np.intersect1d(x, y, assume_unique=True)) if low >= similarity * high else 0
            out.append(both >= similarity * (low + high - both))
        return pa.array(out, pa.bool_())

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.where(alike("x", "y")).select(*pairs.columns)


def _close(left: str, right: str, similarity: float, cut: int) -> Column:
    """Whether sizes and sketches, columns of these structs, allow the similarity."""
    off = sum((F.bit_count(F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))) for i in range(SKETCH_LONGS)),
              F.lit(0))
    few, many = (f(F.col(f"{left}.n"), F.col(f"{right}.n")) for f in (F.least, F.greatest))
    return (few >= similarity * many) & (off <= cut)


class _Links:
    """Components found so far: roots has node and root of the nodes with a link, most at most."""

    def __init__(self, texts: DataFrame, size: int, similarity: float, most: int):
        self.texts, self.size, self.similarity, self.most, self.roots = texts, size, similarity, most, None

    def name(self, rows: DataFrame) -> DataFrame:
        if self.roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def add(self, pairs: DataFrame, most: int) -> bool:
        """Verifies pairs a, b with their roots, most at most, and ties components together; whether any was tied."""
        return self.tie(_alike(pairs, self.texts, self.size, self.similarity), most)

    def tie(self, pairs: DataFrame, most: int | None = None) -> bool:
        """Ties the components of verified pairs together; whether any was tied."""
        new = land(pairs.select("a_root", "b_root").distinct(), "near-links", most)
        n = new.count()
        if not n:
            return False
        moved = land(components(new.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), n),
                     "near-moves", 2 * n)
        if self.roots is None:
            self.roots = moved
            return True
        moves = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
        old = self.roots.join(moves, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        fresh = moved.join(self.roots, "node", "left_anti")
        self.roots = land(old.unionByName(fresh.select("node", "root")), "near-roots", self.most)
        return True


def alike_members(rows: DataFrame, texts: DataFrame, size: int, similarity: float, cut: int) -> DataFrame:
    """Pairs a, b of nodes of one bucket with different roots and alike sets, each once.

    A member brings its set along, so that the join itself verifies a pair: what leaves it are links,
    not candidates, whose number grows with the square of a group. Sizes and sketches come first, and
    only the least of the buckets that a pair shares looks at the sets.
    """
    @F.arrow_udf("array<long>")
    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), size).view(np.int64) for t in texts], pa.list_(pa.int64()))

    # a node is in one bucket a band at most
    nodes = rows.groupBy("node").agg(
        F.min("root").alias("root"), F.min("sketch").alias("sketch"), F.collect_set("bucket").alias("buckets"))
    sets = land(nodes.join(texts, "node").select("node", "root", "sketch", "buckets", hashes("text").alias("set")),
                "near-sets")

    def side(name):
        return sets.select(F.explode("buckets").alias("bucket"), F.col("node").alias(name), *(
            F.col(c).alias(f"{name}_{c}") for c in ("root", "sketch", "buckets", "set")))

    a, b = side("a"), side("b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    alike = shared >= similarity * (F.col("a_sketch.n") + F.col("b_sketch.n") - shared)
    first = a.bucket == F.array_min(F.array_intersect("a_buckets", "b_buckets"))
    pairs = a.join(b.hint("merge"), (a.bucket == b.bucket) & (F.col("a_root") < F.col("b_root"))
                   & _close("a_sketch", "b_sketch", similarity, cut) & first & alike)
    return pairs.select("a", "b", "a_root", "b_root")


def near_links(members: DataFrame, texts: DataFrame, bands: int, size: int, similarity: float) -> DataFrame | None:
    """node, root: components of the nodes that share a bucket and have alike texts; None without links.

    members has columns band, bucket, node and sketch, texts has node and text.
    """
    most = members.count()
    links, waiting = _Links(texts, size, similarity, most), None
    cut = sketch_cut(bands * BAND_HASHES, similarity)
    edges = sorted({0, bands, *(r for r in ROUNDS if r < bands)})
    for low, high in zip(edges, edges[1:]):
        rows = members.where(F.col("band").between(low, high - 1)).select("bucket", "node", "sketch")
        rows = rows if waiting is None else rows.unionByName(waiting)
        for turn in range(TURNS):
            rows, n = _open(links.name(rows), turn, most)
            if not n:
                break
            near = rows.where("root != rep.root").where(_close("sketch", "rep.sketch", similarity, cut))
            pairs = near.select(F.col("node").alias("a"), F.col("rep.node").alias("b"),
                                F.col("root").alias("a_root"), F.col("rep.root").alias("b_root")).distinct()
            found = links.add(pairs, n)
            rows = rows.select("bucket", "node", "sketch")
            if not found:
                break
        waiting = rows.select("bucket", "node", "sketch")
    rows, n = _open(links.name(waiting), TURNS, most)
    if n:                   # no turn ties these together: each component against the others
        links.tie(alike_members(rows, texts, size, similarity, cut))
    return links.roots


def _open(named: DataFrame, turn: int, most: int) -> tuple[DataFrame, int]:
    """Members of the buckets with more than one root, each with a member of its bucket drawn anew;
    and how many there are, most at most."""
    named = land(named.select("bucket", "node", "root", "sketch"), "near-members", most)
    draw = F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "root", "sketch")
    buckets = named.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min(draw).alias("rep")).where("low != high")
    rows = land(named.join(buckets.select("bucket", "rep"), "bucket"), "near-open", most)
    return rows, rows.count()


def group_buckets(nodes: DataFrame) -> DataFrame:
    """band, bucket, node and sketch: the groups that SimHash codes at two differing bits or fewer make.

    nodes has node, sketch and codes, those of all texts of the node. The groups come with the first band.
    """
    codes = nodes.select("node", F.explode("codes").alias("code"))
    groups = simhash.groups(codes, id_col="node").select(
        F.col("doc_id").alias("node"), F.col("component_id").alias("bucket")).distinct()
    return groups.join(nodes.select("node", "sketch"), "node").select(F.lit(0).alias("band"), "bucket", "node", "sketch")


def near_duplicates(df: DataFrame, size: int = 5, similarity: float = 0.8,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near copies: of each group the row with the smallest id stays.

    Texts are linked if their sets of shingles have this Jaccard similarity at least. Candidates are
    pairs that share a SimHash group or a band of min-hashes, which at most MISSED of the pairs just at
    the similarity do not, and whose sketches are no more than SPREAD deviations off (about one pair in three
    million); they are verified by the sets themselves. Texts without words, null ones too, are copies
    of each other; null ids come last; of repeated rows one stays. Rows and sets are told apart by
    hashes of 128 bits. Columns may have any names.
    """
    by = band_hashes(similarity)
    longs = [f"s{i}" for i in range(SKETCH_LONGS)]

    @F.arrow_udf(f"digest binary, bands array<long>, sketch struct<n:int,{','.join(f'{c}:long' for c in longs)}>")
    def signatures(texts: pa.Array) -> pa.Array:
        digests, bands, sketches = [], [], []
        for text in texts:
            hashes = shingle_set(text.as_py(), size)
            least = least_hashes(hashes, by)
            digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            bands.append(np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least)],
                                  np.uint64).view(np.int64) if len(hashes) else [])
            sketches.append((len(hashes), *sketch_of(least).tolist()))
        columns = list(zip(*sketches)) or [()] * (1 + SKETCH_LONGS)
        sketch = pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.int64()] * SKETCH_LONGS])], ["n", *longs])
        return pa.StructArray.from_arrays(
            [pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), sketch],
            ["digest", "bands", "sketch"])

    parts = [F.col(id_col).isNull(), F.col(id_col), F.col(text_col)]
    key = F.struct(F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *reversed(parts)).alias("k2"))
    whole = df.select(F.struct(*df.columns).alias("row"), key.alias("key"), F.col(text_col).alias("text"),
                      F.col(id_col).alias("doc_id"))
    signed = simhash.fingerprints(whole).select("key", "doc_id", "code", signatures("text").alias("s"))
    nodes = land(signed.groupBy(F.col("s.digest").alias("digest")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("best"),
        F.min("s.bands").alias("bands"), F.min("s.sketch").alias("sketch"), F.collect_set("code").alias("codes")).withColumn(
        "node", F.monotonically_increasing_id()).drop("digest"), "signatures")
    rows = nodes.select("node", "sketch", F.posexplode("bands").alias("band", "bucket")).unionByName(group_buckets(nodes))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = land(rows.join(shared, "bucket"), "bucket-members")
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", F.col("best.key").alias("key"))
    # repeated rows have one text, so any of them serves
    texts = whole.select("key", "text").join(wanted, "key").groupBy("node").agg(F.min("text").alias("text"))
    roots = near_links(members, land(texts, "member-texts"), len(by), size, similarity)
    if roots is not None:
        nodes = nodes.join(roots, "node", "left").withColumn("node", F.coalesce("root", "node"))
    kept = nodes.groupBy("node").agg(F.min("best")["key"].alias("key"))
    kept = land(kept.select("key"), "kept-rows")
    # repeated rows differ in nothing
    again = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    return whole.join(kept, "key", "left_semi").withColumn("n", again).where("n = 1").select("row.*")
