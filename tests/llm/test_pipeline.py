"""The corpus pipeline: each stage on its own input, and the whole."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidemark.llm import near, queries


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}


def edited(rnd, words, rate):
    return [w if rnd.random() > rate else f"new{rnd.randrange(10**6)}" for w in words]


def test_near_copies_go_and_others_stay(spark):
    rnd, rows, group = random.Random(8), [], {}
    for g in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 400))]
        rows.append((100 * g, " ".join(words)))
        for c in range(1, 4):
            rows.append((100 * g + c, " ".join(edited(rnd, words, 0.008))))
    rows += [(9000, None), (9001, ""), (9002, "  "), (9003, rows[0][1]), (9003, rows[0][1]), (None, "a b c")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, node int")
    got = [r.doc_id for r in near.near_duplicates(df).collect()]
    assert len(got) == len(set(got)) and {9000, None} <= set(got) and not {9001, 9002, 9003} & set(got)
    originals = {100 * g for g in range(60)}
    assert originals <= set(got)
    close = [i for i, t in rows[:240] if i % 100 and len(shingles(t) & shingles(dict(rows)[i - i % 100])) >= 0.85 * len(
        shingles(t) | shingles(dict(rows)[i - i % 100]))]
    assert len(close) > 100 and len(set(close) & set(got)) <= 0.03 * len(close)


def brute_roots(texts, similarity=0.8):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_passage_edits_and_appended_text_equal_brute_force(spark):
    rnd, texts = random.Random(11), []
    for g in range(60):
        n = rnd.choice([60, 200, 1000])
        words = [f"w{int(5000 * rnd.random() ** 3)}" for _ in range(n)]
        new = lambda k: [f"w{int(5000 * rnd.random() ** 3)}" for _ in range(k)]
        k, at = int(n * rnd.uniform(0.06, 0.13)), rnd.randrange(n // 2)
        texts += [" ".join(x) for x in (words, words[:at] + new(k) + words[at + k:], words + new(int(n * rnd.uniform(0.1, 0.3))))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, x in enumerate(brute_roots(texts)) if i == x}
    assert 60 < len(want) < 150
    assert {r.doc_id for r in near.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("turns", [1, 2])
def test_chains_in_a_hot_group_equal_brute_force(spark, monkeypatch, turns):
    monkeypatch.setattr(near, "TURNS", turns)
    rnd = random.Random(12)
    words = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    texts = []
    for _ in range(150):        # copies around one template, some of them joined only through others
        texts.append(" ".join(edited(rnd, words, 0.02)))
    for _ in range(150):        # and a chain that leads away from it
        words = edited(rnd, words, 0.012)
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, x in enumerate(brute_roots(texts)) if i == x}
    assert {r.doc_id for r in near.near_duplicates(df).collect()} == want


def test_hot_group_of_near_copies(spark):
    rnd = random.Random(9)
    words = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    rows = [(i, " ".join(edited(rnd, words, 0.006))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, x in enumerate(brute_roots([t for _, t in rows])) if i == x}
    assert {r.doc_id for r in near.near_duplicates(df).collect()} == want and len(want) < 15


def test_last_comparison_lets_out_each_alike_pair_once(spark):
    rnd, by = random.Random(21), near.band_hashes(0.8)
    passage, words = ([f"w{rnd.randrange(5000)}" for _ in range(n)] for n in (100, 150))
    texts = [" ".join(passage + [f"w{rnd.randrange(5000)}" for _ in range(50)]) for _ in range(60)]
    texts += [" ".join(edited(rnd, words, 0.02)) for _ in range(80)] + ["a b", "a b", "w w w w w w w", "w w w w w w w w"]
    sets = [near.shingle_set(t, 5) for t in texts]
    rows = [(bucket, i, i // 2, (len(x), *near.sketch_of(near.least_hashes(x, by)).tolist()))
            for i, x in enumerate(sets) for bucket in (7, 9)]
    df = spark.createDataFrame(rows, "bucket long, node long, root long, sketch struct<n:int,s0:long,s1:long,s2:long,s3:long>")
    texts = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = near.alike_members(df, texts, 5, 0.8, near.sketch_cut(by.size, 0.8)).collect()
    sets = [set(x.tolist()) for x in sets]
    alike = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j])
             if i // 2 < j // 2 and len(x & y) >= 0.8 * len(x | y)}
    assert sorted((r.a, r.b) for r in got) == sorted(alike) and len(alike) > 100
    assert all((r.a_root, r.b_root) == (r.a // 2, r.b // 2) for r in got)


def test_close_fingerprints_link_texts_that_share_no_band(spark, monkeypatch):
    monkeypatch.setattr(near, "MISSED", 0.9)        # one band, which every twentieth of these pairs does not share
    rnd, texts = random.Random(31), []
    for _ in range(240):
        words = [f"w{rnd.randrange(5000)}" for _ in range(600)]
        texts += [" ".join(words), " ".join(words[:300] + ["other"] + words[301:])]
    code, by = [int(near.simhash.signature(near.shingle_hashes(t, 3))[0]) for t in texts], near.band_hashes(0.8)
    assert len(by) == 1
    close = [i for i in range(0, len(texts), 2) if (code[i] ^ code[i + 1]).bit_count() <= 2]
    band = [near.least_hashes(near.shingle_set(t, 5), by).tobytes() for t in texts]
    assert sum(band[i] != band[i + 1] for i in close) >= 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in near.near_duplicates(df).collect()}
    assert not got & {i + 1 for i in close} and got >= set(range(0, len(texts), 2))


def test_groups_of_op2_are_buckets(spark, data_dir):
    docs = queries.table(spark, data_dir, "documents")
    want = {}
    for r in queries.op2_simhash(spark, data_dir).collect():
        want.setdefault(r.component_id, set()).add(r.doc_id)
    nodes = near.simhash.fingerprints(docs).select(
        F.col("doc_id").alias("node"), F.lit(1).alias("sketch"), F.array("code", "code").alias("codes"))
    got = {}
    for r in near.group_buckets(nodes).collect():
        got.setdefault(r.bucket, []).append(r.node)
    assert {k: set(v) for k, v in got.items()} == want and sum(map(len, got.values())) == docs.count()
    assert any(len(v) > 1 for v in want.values())


def test_sketches_let_alike_pairs_through():
    rnd, by = random.Random(5), near.band_hashes(0.8)
    cut = near.sketch_cut(by.size, 0.8)
    far = []
    for _ in range(300):
        whole = near.np.array([rnd.getrandbits(64) for _ in range(900)], near.np.uint64)
        a, b, c = whole[:810], whole[90:], whole[450:]      # 0.8, and a half that a holds too
        off = [near.np.bitwise_count((near.sketch_of(near.least_hashes(x, by)) ^ near.sketch_of(
            near.least_hashes(a, by))).view(near.np.uint64)).sum() for x in (b, c)]
        assert off[0] <= cut
        far.append(off[1] > cut)
    assert sum(far) > 250


def test_stages(spark, data_dir):
    docs = queries.table(spark, data_dir, "documents")
    columns = docs.columns
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", None, 0), (5, "", "en", None, 0),
                                 (9999, "word " * 60_000, None, "src1", 1)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in cp.STAGES:
        before = docs.count()
        docs = cp.land(stage(spark, docs, data_dir), "test")
        assert name == "bpe" or docs.columns == columns
        assert name == "mixing" or docs.count() <= before
    assert docs.count() > 0


def test_mixed_rows_have_the_words_taken_in_the_order_of_the_schedule(spark, data_dir):
    rows = [(i, "w " * 50, "en", "big", 100) for i in range(300)] + [
        (900, "  one\ttwo " + "y " * 8000, "en", "small", 16011), (901, "z", "en", "small", 1), (901, "other text", "en", "small", 10),
        (901, "z", "en", "small", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.mixed(spark, docs, data_dir).collect()
    target = {"big": 5, "small": 2}
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in target}
    total, want = 1.5 * sum(sizes.values()), {}
    want["big"] = min(2 * sizes["big"], total * 5 / 7)
    want["small"] = min(2 * sizes["small"], total - want["big"])
    for s in target:
        assert abs(sum(len(r.text.split()) for r in got if r.source == s) - want[s]) <= 1.001
    texts = {(r[0], r[1]) for r in rows}
    cut = [r for r in got if (r.doc_id, r.text) not in texts]
    assert len(cut) <= 2 and all(len(r.text) == r.n_chars and any(t.startswith(r.text) for i, t in texts if i == r.doc_id) for r in cut)
    places = [i for i, r in enumerate(got) if r.source == "big"]
    assert max(b - a for a, b in zip(places, places[1:])) <= 6 and [r.doc_id for r in got] != sorted(r.doc_id for r in got)


def test_clean_documents_stay(spark, data_dir):
    docs = queries.table(spark, data_dir, "documents")
    labels = queries.table(spark, data_dir, "labels")
    kept = cp.good_documents(spark, docs, data_dir).join(labels, "doc_id")
    assert kept.where("quality = 1").count() >= 0.98 * labels.where("quality = 1").count()
    assert kept.where("quality = 0").count() <= 0.2 * labels.where("quality = 0").count()


def test_empty_table(spark, data_dir):
    docs = queries.table(spark, data_dir, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, data_dir)
    assert docs.count() == 0
