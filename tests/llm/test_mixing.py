"""Mixing against targets shared out step by step and a schedule followed slot by slot."""

import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import mixing, queries


def shared_out(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = left / total
        over = {s for s in open_ if target[s] + share * weight[s] >= 2 * sizes[s]}
        if not over:
            for s in open_:
                target[s] += share * weight[s]
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= over
        left = 1.5 * sum(sizes.values()) - sum(target[s] for s in names if s not in open_)
    return target


def check(got, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want, taken = shared_out(sizes), defaultdict(int)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter(
        (i, size(t), sizes[s]) for i, t, s in rows)
    source_of = {i: s for i, _, s in rows}
    for r in got:
        s = source_of[r.doc_id]
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, n in taken.items():
        assert want[s] - 1.001 <= n <= want[s] + 1e-6
    return want


def test_whole_table(spark, data_dir):
    docs = queries.table(spark, data_dir, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    first = queries.op10_mixing(spark, data_dir).collect()
    check(first, rows)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_hot_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    monkeypatch.setattr(mixing, "CHUNK_SLOTS", 16)
    rows = [(i, "w " * (i % 50), "hot") for i in range(300)] + [
        (1000, None, "a"), (1001, "", "a"), (1002, "one two\x0bthree\u00a0x", None), (1003, "x", "\U0001F642"),
        (1004, "y " * 9000, "\uffee"), (1005, "z z", "b"), (1005, "z z", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = df.selectExpr("*", "1 as size", "2 as taken", "3 as sid", "4 as key")
    check(mixing.mix(clash).collect(), rows)
    assert mixing.mix(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None)] * 3, "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(nulls).collect()] == [(0, 0.0, 0)] * 3


def test_prefixes_of_the_schedule_keep_the_shares(spark):
    df = spark.createDataFrame([("a", 60_000), ("b", 30_000), ("c", 30_000)], "source string, size long")
    sources = mixing.targets(df)
    target = {r.sid: r.target for r in sources.collect()}
    n = Counter(r.sid for r in mixing.slots(sources, 10).collect())
    assert all(n[s] == -(-int(t) // 10) for s, t in target.items())


def test_schedule_is_mixed_in_every_prefix_and_adds_up_to_taken(spark):
    rows = [(i, "w " * (30 + i % 90), "a" if i % 2 else "b" if i % 4 else None) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string")
    blocks = sorted(mixing.schedule(df).collect(), key=lambda r: (r.slot, r.stream_at))
    taken, sizes = Counter(), Counter()
    for r in blocks:
        taken[r.doc_id] += r.words
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id] += r.taken
    assert taken == +want
    for _, t, s in rows + rows[:3]:
        sizes[s] += len(t.split())
    target, total, done, so_far = shared_out(sizes), 0, Counter(), 0
    total, slots_of = sum(target.values()), defaultdict(set)
    for r in blocks:
        slots_of[r.slot].add(r.source)
        done[r.source] += r.words
        so_far += r.words
        assert all(abs(done[s] - so_far * target[s] / total) <= 4 * 64 for s in target)
    assert all(len(s) == 1 for s in slots_of.values())      # a slot is one source's block
