"""Language identification: forward-backward by enumeration, held-out accuracy and odd rows."""

import itertools
import zlib

import numpy as np
import pytest

from tidemark.llm import langid, queries


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    sizes, scores = np.array([3, 1, 4]), rng.normal(size=(8, 2))
    moves, begin = rng.normal(size=(2, 2)), rng.normal(size=2)
    got, moved = langid.Chains(sizes, np.arange(8), 2).run(scores, moves, begin, want_moves=True)
    want, pairs, at = np.zeros((8, 2)), np.zeros((2, 2)), 0
    for n in sizes:
        paths = list(itertools.product((0, 1), repeat=n))
        w = np.array([np.exp(begin[p[0]] + sum(scores[at + i, y] for i, y in enumerate(p))
                             + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        for p, x in zip(paths, w / w.sum()):
            for i, y in enumerate(p):
                want[at + i, y] += x
            for a, b in zip(p, p[1:]):
                pairs[a, b] += x
        at += n
    assert np.allclose(got, want) and np.allclose(moved, pairs)


def test_query(spark, data_dir):
    docs = queries.table(spark, data_dir, "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op6_language_id(spark, data_dir).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.97


@pytest.fixture(scope="module")
def model():
    texts = ["the cat and the dog sat on a mat", "this is what they had said to her",
             "der hund und die katze sind nicht hier", "das ist ein haus mit einem garten"] * 5
    return langid.Model(["de", "en"]).fit(texts, (["en"] * 2 + ["de"] * 2) * 5)


def test_code_switching(model):
    reader = langid.Reader(model)
    words = "the cat sat on the mat und der hund ist nicht mit der katze".split()
    ids, scores = reader.ids(words)
    posterior, _ = langid.Chains(np.array([len(words)]), ids, 2).run(scores, model.moves, model.begin)
    assert [model.labels[k] for k in posterior.argmax(1)] == ["en"] * 6 + ["de"] * 8
    assert model.moves[0, 0] > model.moves[0, 1]


def test_odd_rows(spark, model):
    texts = [None, "", "12 3_4 !?", "der hund", "the the the", "der hund", "und " * 20_000]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)],
                               "doc_id long, text string, language int, score int")
    got = [(r.language.lang_pred, round(r.language.score, 3)) for r in
           langid.predict(df, model).orderBy("doc_id").collect()]
    assert got[:3] == [("und", 0.0)] * 3 and [x for x, _ in got[3:]] == ["de", "en", "de", "de"]
    none = langid.train(df.selectExpr("text", "cast(null as string) lang"))
    assert {r.language.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_long_texts_and_long_words(model, monkeypatch):
    texts = [langid.letters(t) for t in ("der hund " * 3000, "", "the cat " * 10, "katze" * 500, "und")]
    assert max(map(len, texts[3])) <= 40 and len(texts[3]) == 63
    want = langid.Reader(model).predict(texts)
    monkeypatch.setattr(langid, "CHUNK_WORDS", 1000)        # a text over several chunks
    got = langid.Reader(model).predict(texts)
    assert [x for x, _ in got] == [x for x, _ in want] == ["de", "und", "en", "de", "de"]
    assert np.allclose([p for _, p in got], [p for _, p in want], atol=1e-3)
