"""Document fingerprints by content-defined chunking.

A gear hash over a sliding window of bytes marks possible chunk ends; normalised chunking asks for
more bits before the normal size than after it. The same content gives the same chunks wherever it
stands, so the share of a document's bytes in chunks that another one has measures containment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

WINDOW = 16                 # bytes of the gear hash; also the smallest chunk
NORMAL, LARGEST = 48, 256   # bytes
STRICT, LOOSE = 7, 5        # bits asked for before and after the normal size
RANGE_ROWS, MOST_RANGES = 4_000, 20_000
OUT_CHARS = 2_000_000
EDITS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64())])
GEAR = np.random.Generator(np.random.PCG64(20240611)).integers(0, 1 << 16, 256, np.uint16)


def chunk_ends(data: bytes) -> list[int]:
    """Chunk ends of a byte string; the last is its length."""
    n = len(data)
    if n <= WINDOW:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:       # h[i]: sum of GEAR[data[i - k]] << k over the window
        h[width:] += h[:-width] << np.uint16(width)
        width *= 2
    loose = np.flatnonzero(h < (1 << 16 - LOOSE))
    strict = (h[loose] < (1 << 16 - STRICT)).tolist()
    ends, start, at, loose = [], 0, 0, loose.tolist()
    while n - start > WINDOW:
        end = min(n, start + LARGEST)
        while at < len(loose):
            size = loose[at] + 1 - start
            if size >= end - start:
                break
            if size >= NORMAL or size >= WINDOW and strict[at]:
                end = start + size
                break
            at += 1
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def digest(text: str) -> str:
    """Digest and bytes of each distinct chunk, 'hhhhhhhhhh:bytes' in digest order, with a comma between."""
    data, start, weight = text.encode(), 0, {}
    for end in chunk_ends(data):
        key = xxhash.xxh3_64_hexdigest(data[start:end])[:10]
        weight[key] = weight.get(key, 0) + end - start
        start = end
    return ",".join(f"{k}:{w}" for k, w in sorted(weight.items()))


def _weights(fingerprint: str) -> dict[str, int]:
    return {x[:10]: int(x[11:]) for x in fingerprint.split(",")} if fingerprint else {}


def likeness(a: str, b: str) -> float:
    """Containment: bytes in common chunks by the bytes of the smaller document; 1 for equal ones."""
    if a == b:
        return 1.0
    a, b = _weights(a), _weights(b)
    smaller = min(sum(a.values()), sum(b.values()))
    if len(a) > len(b):
        a, b = b, a
    return sum(min(w, b[k]) for k, w in a.items() if k in b) / smaller if smaller else 0.0


def fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each whole text; a column named out_col is replaced.

    A null text counts as empty, and an empty text has an empty fingerprint. Equal texts have equal
    fingerprints.
    """
    @F.arrow_udf("string")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([digest(x.as_py() or "") for x in texts], pa.string())

    return df.withColumn(out_col, fingerprints(F.col(text_col)))


def against_edits(docs: DataFrame) -> DataFrame:
    """Likeness of each document to its next one and to an edit that takes half of that.

    Columns: doc_id, n_chars, edited (the last half of the text replaced by as much of the next
    text), fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as empty.
    Documents go by descending doc_id, null ids last, rows of one id by a hash of their text; the
    first follows the last. The table is cut into ranges of ids, and the first rows of a range also
    go to the range before it, so that each range holds its rows' next ones: one exchange of the
    texts, then one pass over the sorted range that remembers a single row. The driver sees one id for each of at most MOST_RANGES ranges.
    """
    ids = docs.select("doc_id")
    ranges = max(1, min(MOST_RANGES, ids.count() // RANGE_ROWS))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = ids.select(F.percentile_approx("doc_id", steps, 50 * ranges)).first()[0] if steps else ()
    cuts = np.array(sorted(set(cuts or ())), np.int64)

    def positions(values: pa.Array) -> np.ndarray:      # 0: the largest ids
        known = values.fill_null(0).to_numpy(zero_copy_only=False)
        at = len(cuts) - np.searchsorted(cuts, known, "left")
        return np.where(values.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, at)

    @F.arrow_udf("int")
    def range_of(values: pa.Array) -> pa.Array:
        return pa.array(positions(values).astype(np.int32))

    heads = ids.groupBy(range_of("doc_id").alias("part")).agg(F.max("doc_id").alias("first")).collect()
    parts = sorted(r.part for r in heads)
    before = dict(zip(parts, parts[-1:] + parts[:-1], strict=True))
    first = {r.part: r.first for r in heads}

    @F.arrow_udf("array<int>")
    def places(values: pa.Array) -> pa.Array:
        return pa.array([[p, before[p]] if first[p] == v else [p]
                         for p, v in zip(positions(values).tolist(), values.to_pylist(), strict=True)],
                        pa.list_(pa.int32()))

    def compare(batches):
        held, out, size = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                row["fingerprint"] = digest(row["text"])
                if held and not held["tail"] and held["part"] == row["part"]:
                    out.append(_edit(held, row))
                    size += len(held["text"])
                held = row
                if size >= OUT_CHARS:
                    yield pa.RecordBatch.from_pylist(out, EDITS)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, EDITS)

    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text, F.posexplode(places("doc_id")).alias("tail", "part"))
    return rows.repartition("part").sortWithinPartitions(
        "part", "tail", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text",
    ).mapInArrow(compare, "doc_id long, n_chars long, edited string, fingerprint string, "
                 "edited_fingerprint string, near_edited double, near_next double")


def _edit(row: dict, after: dict) -> dict:
    n = len(row["text"])
    edited = row["text"][:n - n // 2] + after["text"][:n // 2]
    own, changed = row["fingerprint"], digest(edited)
    return {"doc_id": row["doc_id"], "n_chars": n, "edited": edited, "fingerprint": own,
            "edited_fingerprint": changed, "near_edited": likeness(own, changed),
            "near_next": likeness(own, after["fingerprint"])}
