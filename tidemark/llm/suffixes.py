"""Exact substring dedup with suffix arrays over shards that content brings together.

Each window of LENGTH bytes is represented by the smallest hash of the grams in it; windows next to
each other mostly share it, so a document is a sequence of stretches with one such anchor. Equal
windows have equal anchors. Stretches whose anchor is nowhere else are done, and equal stretches
collapse to one. The rest goes, by anchor, to shards of bounded size: in each, prefix doubling ranks
the suffixes until windows of equal rank are equal. Anchors with more text than a shard are spread
over several; their distinct windows, sorted by digest, are merged by binary search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.session import land

LENGTH, GRAM = 400, 32
LONGEST_RUN = 2_048             # window starts in one stretch
SHARD_BYTES = 2_000_000
_RNG = np.random.Generator(np.random.PCG64(97))
BYTES = _RNG.integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
FACTORS = _RNG.integers(0, 1 << 63, 8, np.uint64) << np.uint64(1) | np.uint64(1)
DOC = ("doc_id", "digest")


def _sliding(values: np.ndarray, width: int, join) -> np.ndarray:
    """join over each window of width values, by windows that double."""
    done, step = values, 1
    while 2 * step <= width:
        done = join(done[:-step], done[step:], step)
        step *= 2
    return join(done[:len(values) - width + 1], done[width - step:], 0) if step < width else done


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each stretch, its anchor, and whether that may repeat in it."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    gram = min(GRAM, 1 << (length.bit_length() - 2))
    h = _sliding(BYTES[np.frombuffer(data, np.uint8)], gram,
                 lambda x, y, step: x * FACTORS[step.bit_length() - 1] + y)
    h = (h ^ h >> np.uint64(29)) * FACTORS[7]
    h ^= h >> np.uint64(32)
    width = length - gram + 1
    least = _sliding(h, width, lambda x, y, step: np.minimum(x, y))
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    last = np.concatenate([first[1:], [len(least)]]) - 1
    if (last - first).max() >= LONGEST_RUN:
        pieces = [np.arange(a, b + 1, LONGEST_RUN) for a, b in zip(first, last)]
        ends = [np.append(p[1:] - 1, b) for p, b in zip(pieces, last)]
        first, last = np.concatenate(pieces), np.concatenate(ends)
    key = least[first]
    again = np.array([np.count_nonzero(h[a:b + width] == k) > 1 for a, b, k in zip(
        first.tolist(), last.tolist(), key)], bool)
    return first, last, key.view(np.int64), again


def suffix_ranks(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes by their first length bytes, of fewer where a part of text ends.

    Larsson-Sadakane refinement: ranks by h bytes give ranks by 2h; only suffixes that still share
    their rank with others are sorted again.
    """
    n = len(text)
    room = ends - np.arange(n)              # bytes up to the end of its part
    rank = text.astype(np.int64) + 1
    open_, h = np.arange(n), 1
    while True:
        step = min(h, length - h)
        if step <= 0 or not len(open_):
            return rank
        # beyond the end of a part nothing follows: rank 0
        behind = np.where(room[open_] > step, rank[np.minimum(open_ + step, n - 1)], 0)
        order = np.lexsort((behind, rank[open_]))
        pos, head, tail = open_[order], rank[open_][order], behind[order]
        new_head = np.concatenate([[True], head[1:] != head[:-1]])
        new = new_head | np.concatenate([[True], tail[1:] != tail[:-1]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(pos)))
        # a group keeps its first rank; parts of it move up by the suffixes before them
        base = np.maximum.accumulate(np.where(new_head, np.arange(len(pos)), 0))
        if h == 1:
            rank[pos] = np.repeat(starts, sizes) + 1
        else:
            rank[pos] = head + np.repeat(starts, sizes) - base
        open_ = pos[np.repeat(sizes > 1, sizes)]
        h += step


def repeated(parts: list[bytes], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part, which of its windows stand elsewhere in parts too, and which of them stand first."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    rank = suffix_ranks(text, np.repeat(offsets[1:], sizes), length)
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(offsets, offsets[1:])])
    _, first, group, counts = np.unique(rank[starts], return_index=True, return_inverse=True, return_counts=True)
    lone = np.zeros(len(starts), bool)
    lone[first] = True
    cuts = np.cumsum([b - a - length + 1 for a, b in zip(offsets, offsets[1:])])[:-1]
    return list(zip(np.split(counts[group] > 1, cuts), np.split(lone, cuts)))


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and last position of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc_id, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode()
                first, last, key, again = anchors(data, length)
                out[0] += [doc_id] * len(first)
                out[1] += [digest] * len(first)
                for column, values in zip(out[2:6], (first, last, key, again)):
                    column += values.tolist()
                out[6] += [xxhash.xxh3_64_intdigest(data[a:b + length]) - (1 << 63)
                           for a, b in zip(first.tolist(), last.tolist())]
            types = [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [
                *DOC, "first", "last", "anchor", "again", "content"])

    return docs.select(*DOC, "text").mapInArrow(
        cut, "doc_id long, digest long, first int, last int, anchor long, again boolean, content long")


def duplicate_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, digest, first, last: runs of starts whose windows of length bytes also start elsewhere.

    docs has doc_id, digest (of the text) and text. Rows of equal id and text are different documents.
    """
    stretches = land(_stretches(docs, length), "stretches")
    place = F.struct(*DOC, "first", "last", "again")
    contents = land(stretches.groupBy("anchor", "content").agg(
        F.count("*").alias("n"), F.min(place).alias("at")), "contents")
    size = F.col("at.last") - F.col("at.first") + length
    wanted = contents.groupBy("anchor").agg(
        F.count("*").alias("kinds"), F.bool_or("at.again").alias("again"), F.sum(size).alias("bytes"))
    wanted = wanted.where("kinds > 1 or again").select(
        "anchor", F.ceil(F.col("bytes") / SHARD_BYTES).cast("int").alias("shards"))
    whole = stretches.join(contents.where("n > 1").select("anchor", "content"), ["anchor", "content"]) \
        .select(*DOC, "first", "last")
    single = contents.join(wanted, "anchor").select(
        "at.doc_id", "at.digest", "at.first", "at.last", "anchor", "shards",
        F.when(F.col("shards") > 1, F.pmod("content", "shards")).otherwise(0).alias("shard"))
    single = land(single, "shard-places")
    by_doc = single.groupBy(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest")).agg(
        F.collect_list(F.struct("first", "last", "anchor", "shards", "shard")).alias("places"))
    # repeated rows give a part twice; all its windows are duplicates already
    texts = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("of_id"))
                      & (F.col("digest") == F.col("of_digest")))
    bytes_ = F.encode("text", "utf-8")
    parts = texts.select(*DOC, bytes_.alias("data"), F.explode("places").alias("p")).select(
        *DOC, "p.first", "p.anchor", "p.shard", "p.shards",
        F.substring("data", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + length).alias("data"))
    found = land(_shards(parts, length), "shard-windows")
    return whole.unionByName(found.where("payload is null").select(*DOC, "first", "last")).unionByName(
        _merged(found.where("payload is not null").select("anchor", "part", "payload")))


def _shards(parts: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows in each shard; of spread anchors also their distinct windows.

    These are packed as WINDOW records sorted by digest, a row for each range of digests.
    """
    def search(batches):
        held, size, at = [], 0, None

        def flush():
            out, records = [], []
            for r, (twice, lone) in zip(held, repeated([r["data"] for r in held], length), strict=True):
                doc = r["doc_id"], r["digest"]
                out += [(*doc, r["first"] + a, r["first"] + b, *[None] * 3) for a, b in _spans(twice)]
                if r["shards"] > 1:
                    records += [(xxhash.xxh3_128_digest(r["data"][s:s + length]), r["doc_id"] is not None,
                                 doc[0] or 0, doc[1], r["first"] + s) for s in np.flatnonzero(lone).tolist()]
            if records:
                records = np.array(records, WINDOW)
                records = records[np.argsort(records["window"])]
                anchor, ranges = held[0]["anchor"], held[0]["shards"]
                part = np.frombuffer(records["window"].tobytes(), np.uint8)[::16].astype(np.int64) * ranges // 256
                cuts = np.searchsorted(part, np.arange(ranges + 1))
                out += [(*[None] * 4, anchor, k, records[i:j].tobytes())
                        for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
            return pa.RecordBatch.from_pylist([dict(zip(SHARD.names, o, strict=True)) for o in out], SHARD)

        for batch in batches:
            for row in batch.to_pylist():
                key = row["anchor"], row["shard"]
                alone = row["shards"] > 1 or (held and held[-1]["shards"] > 1)
                if key != at and (size >= SHARD_BYTES // 2 or alone):
                    if held:
                        yield flush()
                    held, size = [], 0
                at = key
                held.append(row)
                size += len(row["data"])
        if held:
            yield flush()

    key = ["anchor", "shard"]
    return parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(
        search, "doc_id long, digest long, first int, last int, anchor long, part int, payload binary")


def _merged(lists: DataFrame) -> DataFrame:
    """Runs of windows that several shards of an anchor have, from their lists of one digest range."""
    def merge(batches):
        held, at = [], None

        def flush():
            # each list looks its windows up in the lists before it
            known, twice = held[0], []
            for more in held[1:]:
                place = np.searchsorted(known["window"], more["window"])
                same = known["window"][np.minimum(place, len(known) - 1)] == more["window"]
                twice += [more[same], known[place[same]]]
                known = np.insert(known, place[~same], more[~same])
            found = np.unique(np.concatenate(twice)[["known", "doc_id", "digest", "first"]]) if twice else ()
            runs = []
            for known, doc_id, digest, first in [x.item() for x in found]:
                doc = doc_id if known else None, digest
                if runs and runs[-1][:2] == doc and runs[-1][3] == first - 1:
                    runs[-1] = *runs[-1][:3], first
                else:
                    runs.append((*doc, first, first))
            return pa.RecordBatch.from_pylist([dict(zip(RUNS.names, r, strict=True)) for r in runs], RUNS)

        for batch in batches:
            for row in batch.to_pylist():
                key = row["anchor"], row["part"]
                if key != at and held:
                    yield flush()
                    held = []
                at = key
                held.append(np.frombuffer(row["payload"], WINDOW))
        if held:
            yield flush()

    key = ["anchor", "part"]
    return lists.repartition(*key).sortWithinPartitions(*key).mapInArrow(
        merge, "doc_id long, digest long, first int, last int")


RUNS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
SHARD = pa.schema([*RUNS, ("anchor", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])
WINDOW = np.dtype([("window", "V16"), ("known", bool), ("doc_id", "i8"), ("digest", "i8"), ("first", "i4")])


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text, spans (start and end byte of each removed run) and kept (the other bytes).

    A byte goes if a string of length bytes that covers it starts anywhere else too, in the same
    document or another; overlaps count, and all are judged on the input. Matches never cross
    documents. Null texts are empty; repeated rows are documents of their own, null ids too.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("digest"))
    found = duplicate_windows(docs, length)
    found = found.groupBy(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest")).agg(
        F.collect_set(F.struct("first", "last")).alias("windows"))

    @F.arrow_udf("spans array<struct<start:int,end:int>>, kept binary")
    def cut(texts: pa.Array, windows: pa.Array) -> pa.Array:
        spans, kept = [], []
        for text, found in zip(texts, windows, strict=True):
            data, runs, pieces, upto = text.as_py().encode(), [], [], 0
            for w in sorted(found.as_py() or (), key=lambda w: w["first"]):
                a, b = w["first"], w["last"] + length
                if runs and a <= runs[-1]["end"]:
                    runs[-1]["end"] = max(b, runs[-1]["end"])
                else:
                    runs.append({"start": a, "end": b})
            for r in runs:
                pieces.append(data[upto:r["start"]])
                upto = r["end"]
            spans.append(runs)
            kept.append(b"".join([*pieces, data[upto:]]))
        return pa.StructArray.from_arrays([
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array(kept, pa.binary())], ["spans", "kept"])

    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("of_id"))
                       & (F.col("digest") == F.col("of_digest")), "left")
    return joined.withColumn("cut", cut("text", "windows")).select("doc_id", "text", "cut.*")
