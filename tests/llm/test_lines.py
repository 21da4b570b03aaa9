"""Line dedup against a search over all pairs of places."""

import random

import duckdb
import pytest

from tidemark.llm import lines, queries


def slow(rows, least):
    """Line numbers that each document loses: every run that stands earlier, place by place."""
    docs = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0]))
    split = [[line for line in t.split("\n")] for _, t in docs]
    # places are lines with words; blank lines between go with their run
    solid = [[(i, x) for i, x in enumerate(ls) if x.split()] for ls in split]
    gone = [set() for _ in docs]
    for d, a in enumerate(solid):
        for i in range(len(a)):
            for e in range(d + 1):
                b = solid[e]
                for j in range(len(b) if e < d else i):
                    n = k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k][1] == b[j + k][1]:
                        n += len(a[i + k][1].split())
                        k += 1
                    if n >= least:
                        gone[d] |= set(range(a[i][0], a[i + k - 1][0] + 1))
    return {key: (len(g), "\n".join(x for i, x in enumerate(ls) if i not in g))
            for (key, _), ls, g in zip(docs, split, gone, strict=True)}


@pytest.mark.parametrize("seed", range(3))
def test_equals_search_over_all_places(spark, seed):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 6))) for _ in range(12)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for i in range(25)]
    rows += [(100, None), (101, ""), (102, "a b\n" * 300), (None, rows[3][1]), (103, "long " * 5000)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows],
                               "doc_id long, text string, words int, digest int, removed_lines int")
    got = lines.dedup_lines(df, min_words=8).collect()
    want = slow(rows, 8)
    assert len(got) == len(rows)
    for r in got:
        assert (r.removed_lines, r.text) == (want[r.doc_id] if r.doc_id != 100 else (0, None))
        assert (r.words, r.digest) == (1, 2)


def test_repeated_rows_and_empty_table(spark):
    text = "one two three four\nfive six seven eight"
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.dedup_lines(df, min_words=8).collect())
    assert got == [(1, text), (1, text), (2, "")]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_query_equals_sql(spark, data_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data_dir}/documents.parquet'")
    want = con.execute(queries.SQL["op9_line_dedup"]).fetchall()
    got = [tuple(r) for r in queries.op9_line_dedup(spark, data_dir).collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in got) > 0
