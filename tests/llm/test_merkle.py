"""Merkle manifest against plain lists, its layout, and tampered rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import merkle, queries


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """All levels over the nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1:a + 8])))
        i //= 8
    return out


def plain(docs):
    """Rows of the query from lists; docs are (doc_id, text, lang, source, n_chars)."""
    def leaf(d, text):
        return H(*map(field, (d[0], d[3], d[2], d[4], text)))

    trees = {}
    for lang in sorted({d[2] for d in docs}, key=lambda x: (x is not None, x or "")):
        own = sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
        trees[lang] = own, climb([leaf(d, d[1]) for d in own])
    top = climb([levels[-1][0] for _, levels in trees.values()])
    for at, (own, levels) in enumerate(trees.values()):
        for i, d in enumerate(own):
            steps = way(levels, i) + way(top, at)
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
            lowered = None if d[1] is None else d[1].translate(
                str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            node = leaf(d, lowered if hit else d[1])
            for before, after in steps:
                node = H(before, node, after)
            root = top[-1][0]
            yield d[0], leaf(d, d[1]), levels[-1][0], root, H(*(x for s in steps for x in s)), node, node == root


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, grp int, seen int"


def checked(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    return sorted(map(tuple, queries.manifest_checks(df).collect()), key=repr)


@pytest.mark.parametrize("height", [1, 2, 3, 4, 7])
def test_layout(height):
    seen = [merkle.address(height, d, np.arange(8 ** d)) for d in range(min(height, 4) + 1)]
    every = np.concatenate(seen)
    assert len(set(every.tolist())) == len(every) and seen[0][0] == 0
    if height < 5:
        assert sorted(every.tolist()) == list(range(merkle.size_of(height)))
    # a subtree of the lower half is one piece
    low = height - (height + 1) // 2
    if 1 <= low and height < 5:
        first = [merkle.address(height, d, np.arange(8 ** (d - (height - low)))) for d in range(height - low, height + 1)]
        piece = np.sort(np.concatenate(first))
        assert (np.diff(piece) == 1).all()


def test_blocks_of_blocks_equal_lists(spark):
    rnd = random.Random(1)
    rows = [(i, f"Text {rnd.random()} É", rnd.choice(["en"] * 9 + ["de", None, ""]), None, i) for i in range(700)]
    rows += [(1000, "lone", "xx", "s", 1)] + [(2000 + i, "X", f"l{i}", "s", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {r[0]: r for r in plain(rows)}
    fields = [queries.F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    flat = df.select(queries.F.col("lang").alias("grp"), queries.F.col("doc_id").alias("id"),
                     merkle.leaf(fields).alias("leaf"), queries.F.lit("kept").alias("seen"))
    for height in (1, 2):       # four and two levels of blocks
        got = merkle.manifest(flat, height).withColumn("to", merkle.fold(queries.F.col("leaf"), queries.F.col("proof")))
        got = got.collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.leaf, r.subroot, r.root) == want[r.id][1:4] and r.to == r.root and r.seen == "kept"
            assert H(*(x for s in r.proof for x in s)) == want[r.id][4]


def test_odd_rows(spark):
    rows = [(1, "Ab", "en", "s", 2), (1, "Ab", "en", "s", 2), (1, "Zz", "en", None, None), (None, "Q", "en", "s", 1),
            (None, "Q", None, None, None), (5, None, "en", "s", 0), (6, "", "", "", 0), (12, "long word " * 50_000, "de", "s", 1)]
    rows += [(100 + i, "Same Text", "en", "s", 9) for i in range(30)] + [(77, "Same Row", "en", "s", 9)] * 20
    got = checked(spark, rows)
    assert got == sorted(plain(rows), key=repr)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    assert checked(spark, rows[6:7]) == sorted(plain(rows[6:7]), key=repr)
    assert checked(spark, []) == []


def test_query_equals_sql(spark, data_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data_dir}/documents.parquet'")
    want = con.execute(queries.SQL["op12_merkle"]).fetchall()
    got = [tuple(r) for r in queries.op12_merkle(spark, data_dir).collect()]
    assert sorted(got) == sorted(want)
