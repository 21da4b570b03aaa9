"""SimHash codes, trie joins and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import queries, simhash
from tidemark.llm.components import components


def slow_code(text, size=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    runs = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(rows, budget=2):
    codes = [c for _, c in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= budget:
                label[find(i)] = find(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(key)
    return [min((k for k in ids[find(i)] if k is not None), default=None) for i in range(len(rows))]


def test_query_equals_brute_force(spark, data_dir):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, data_dir, "documents").collect()]
    rows = [(i, slow_code(t)) for i, t in docs]
    want = {(i, f"{c:016x}", g) for (i, c), g in zip(rows, slow_groups(rows), strict=True)}
    assert set(map(tuple, queries.op2_simhash(spark, data_dir).collect())) == want


@pytest.mark.parametrize("limit", [20_000, 3])
def test_groups_of_codes(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SUBTRIE_CODES", limit)
    rnd, codes = random.Random(limit), [0, (1 << 64) - 1]
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            base ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
            codes.append(base)
    codes += [0x10 ^ 1 << i for i in range(40)] + [0, 0]     # a dense cluster
    rows = [(i if i % 7 else None, c) for i, c in enumerate(codes, 1)]
    df = spark.createDataFrame([(i, simhash._signed(c), 1, 2) for i, c in rows],
                               "doc_id long, code long, root int, node int")
    got = sorted(((r.doc_id or 0, r.code, r.component_id) for r in simhash.groups(df).collect()))
    want = sorted((i or 0, simhash._signed(c), g) for (i, c), g in zip(rows, slow_groups(rows), strict=True))
    assert got == want


def test_node_pairs_prune_nothing_near(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 2)
    rnd = np.random.default_rng(3)
    codes = np.unique(rnd.integers(0, 1 << 12, 600, np.uint64) << np.uint64(50))
    got = {(i, j) for a, b in simhash.node_pairs(codes, 2) for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for j in range(len(codes)) for i in range(j) if bin(int(codes[i] ^ codes[j])).count("1") <= 2}
    assert got == want


def test_odd_texts(spark):
    texts = [None, "", " \t", "One two", "one TWO", "a b c d", "É é", "x " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in queries.simhash_groups(df).collect()}
    assert [got[i].fingerprint for i in range(8)] == [f"{slow_code(t):016x}" for t in texts]
    assert got[0].component_id == got[2].component_id == 0 and got[4].component_id == 3
    assert queries.simhash_groups(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(40), rnd.randrange(40)) for _ in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    alone = {x for x in label if not any(x in e and e[0] != e[1] for e in edges)}
    assert got == {k: v for k, v in label.items() if k not in alone}
