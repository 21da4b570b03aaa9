"""Multi-index hashing against comparing each query with every row."""

import random
import re

import pytest

from tidemark.llm import hamming, queries


def slow(rows, asked, k):
    out = set()
    for q, code in asked:
        others = sorted({(bin((code ^ c) & (1 << 64) - 1).count("1"), i) for i, c in rows if i != q})
        out |= {(q, n, i, d) for n, (d, i) in enumerate(others[:k], 1)}
    return out


def test_query(spark, data_dir):
    rows = [(r.vec_id, r.code) for r in
            hamming.codes(queries.table(spark, data_dir, "embeddings")).select("vec_id", "code").collect()]
    got = queries.op7_hamming_search(spark, data_dir).collect()
    assert {tuple(r) for r in got} == slow(rows, [r for r in rows if r[0] % 20 == 0], 10)


def test_ties_hot_codes_and_odd_rows(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) - (1 << 63) for _ in range(30)]
    rows = [(i, base[0] if i % 3 == 0 else base[i % 30] ^ 1 << rnd.randrange(60)) for i in range(200)]
    extra = rows + rows[:5] + [(None, 5), (900, None)]
    df = spark.createDataFrame([(i, c, 1, 2) for i, c in extra], "vec_id long, code long, q int, rank int")
    got = hamming.top_k(df, df.where("vec_id % 20 = 0 or vec_id is null"), k=4).collect()
    assert {tuple(r) for r in got} == slow(rows, [r for r in rows if r[0] % 20 == 0], 4)
    few = hamming.top_k(df.where("vec_id < 3"), df.where("vec_id = 0"), k=4).collect()
    assert {tuple(r) for r in few} == slow(rows[:3], rows[:1], 4)
    assert hamming.top_k(df.limit(0), df).count() == 0 and hamming.top_k(df, df.limit(0)).count() == 0


def test_codes_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0.0, None, float("nan")]), (4, [1.0, 2.0])],
                               "vec_id long, embedding array<float>")
    got = {r.vec_id: r.code for r in hamming.codes(df).collect()}
    assert got[1] is None and got[2] == got[3] == 0 and got[4] not in (0, None)
    assert hamming.codes(df.limit(0)).count() == 0


@pytest.mark.parametrize("held, asked, candidates", [(1 << 15, 1 << 10, 1 << 20), (64, 16, 256), (4, 3, 1)])
def test_far_neighbours_without_rows_of_probes(spark, monkeypatch, held, asked, candidates):
    """Unlike codes ask for radii with many flips; rows only name the high bits that a query visits."""
    for name, value in (("HELD", held), ("ASKED", asked), ("CANDIDATES", candidates)):
        monkeypatch.setattr(hamming, name, value, raising=False)
    lists, landed = [], hamming.land

    def land(df, *args):
        lists.extend(re.findall(r"explode\(\[([-\d,]*)\]", df._jdf.queryExecution().optimizedPlan().toString()))
        return landed(df, *args)

    monkeypatch.setattr(hamming, "land", land)
    rnd = random.Random(8)
    rows = [(i, rnd.getrandbits(64) - (1 << 63)) for i in range(500)]
    rows += [(i, i << 52 | 7) for i in range(500, 540)]      # one value in most segments
    df = spark.createDataFrame(rows, "vec_id long, code long")
    got = hamming.top_k(df, df.where("vec_id % 20 = 0"), k=5).collect()
    assert {tuple(r) for r in got} == slow(rows, [r for r in rows if r[0] % 20 == 0], 5)
    if held > len(rows):
        assert lists and max(len(x.split(",")) for x in lists) == 1


def test_ids_may_be_text(spark):
    rnd = random.Random(9)
    rows = [(f"v{i}", rnd.getrandbits(8)) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id string, code long")
    got = hamming.top_k(df, df.where("vec_id like '%0'"), k=3).collect()
    assert {tuple(r) for r in got} == slow(rows, [r for r in rows if r[0].endswith("0")], 3)
