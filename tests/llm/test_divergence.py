"""Divergences of sources against plain dictionaries."""

import random
import re
from collections import Counter, defaultdict

import duckdb

from tidemark.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=200):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    for lang in {k[0] for k in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        own = {s: c for (x, s), c in groups.items() if x == lang}

        def chance(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p = {s: chance(c) for s, c in own.items()}
        q = chance(sum(own.values(), Counter()))
        for s in own:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, last in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                yield from ((lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:last], 1))


def audited(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows],
                               "doc_id long, text string, lang string, source string, term int, n int, shard int")
    return sorted(map(tuple, divergence.audit(df).collect()))


def test_equals_dictionaries(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"{rnd.choice(['Alpha', 'élan', 'ÉTÉ', 'x', 'Ω', '語'])}{chr(97 + i % 26)}" for i in range(120)]
    rows = []
    for i in range(300):
        mine = rnd.choices(words, [1 / (1 + j) for j in range(120)], k=rnd.randint(0, 40))
        rows.append((i, rnd.choice([" ", "-", "\t1", "\x00", "\x7f"]).join(mine), rnd.choice(["en", "de", "en", "en"]),
                     rnd.choice(["a", "b", "c", "É", "B"])))
    rows += [(900, None, "en", "none"), (901, "", "en", "none"), (902, "only once", "fr", "a"), (903, "twice", "fr", "b"),
             (904, None, None, None), (905, "x y", "", None), (906, "x", None, ""), (907, "x", "", "z"), (908, "1 2 3", "it", "a")]
    rows += [(1000, "one row many times", "en", "a")] * 50 + [(1001, "loooong word " * 60_000, "de", "a")]
    assert audited(spark, rows) == sorted(plain(rows))
    monkeypatch.setattr(divergence, "CELLS", 40)        # many shards
    assert audited(spark, rows) == sorted(plain(rows))


def test_batches_are_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "BATCH_BYTES", 100)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 60, "source": ["s"] * 60, "text": ["word " * (i % 9) for i in range(60)]})
    parts = [r for b in divergence.partial_counts([batch]) for r in b.to_pylist()]
    assert len(parts) > 5 and sum(r["n"] for r in parts) == sum(i % 9 for i in range(60))
    assert sum(r["docs"] for r in parts) == sum(i % 9 > 0 for i in range(60))


def test_no_rows_and_no_terms(spark):
    assert audited(spark, []) == []
    assert audited(spark, [(1, None, "en", "a"), (2, "", "en", "b")]) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_query_equals_sql(spark, data_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data_dir}/documents.parquet'")
    want = con.execute(queries.SQL["op13_divergence"]).fetchall()
    got = [tuple(r) for r in queries.op13_divergence(spark, data_dir).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100
