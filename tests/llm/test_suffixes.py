"""Substring dedup against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import queries, suffixes


def slow(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (key, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(x for x, g in zip(d, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((key, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_ranks_equal_sorted_strings():
    rnd = random.Random(3)
    parts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 40))).encode() for _ in range(12)]
    text = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
    for length in (1, 2, 3, 7, 16):
        rank = suffixes.suffix_ranks(text, ends, length)
        cut = [bytes(text[i:min(i + length, e)]) for i, e in enumerate(ends)]
        order = sorted(range(len(cut)), key=lambda i: rank[i])
        assert all(cut[a] <= cut[b] and (cut[a] == cut[b]) == (rank[a] == rank[b]) for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("shard", [2_000_000, 300])
def test_equals_counting(spark, monkeypatch, shard):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", shard)
    rnd, length = random.Random(shard), 24
    word = lambda n: "".join(rnd.choice("abcdeé") for _ in range(n))
    hot, rows = word(60), []
    for i in range(60):
        rows.append((i, word(rnd.randint(0, 90)) + (hot[rnd.randrange(20):] if i % 2 else "") + word(rnd.randint(0, 60))))
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "a" * 3000), (104, word(10) * 9), (105, word(24) * 2)]
    rows += [(106, "repeated row " * 2 + word(30))] * 2 + [(None, rows[5][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, digest int, spans int")
    got = sorted((tuple(r)[:5] for r in queries.substring_digests(df, length).collect()), key=str)
    assert got == slow(rows, length)


def test_query(spark, data_dir):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, data_dir, "documents").collect()]
    got = sorted((tuple(r)[:5] for r in queries.op4_suffix_dedup(spark, data_dir).collect()), key=str)
    assert got == slow(docs, 400)
    empty = queries.table(spark, data_dir, "documents").limit(0)
    assert queries.substring_digests(empty).count() == 0
