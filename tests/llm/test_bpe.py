"""Byte-pair encoding against the tokenizers library."""

import hashlib
import random

import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from tidemark.llm import bpe, queries

FILE = queries.TOKENIZER
TEXTS = [None, "", " ", "a", "  two  spaces \n", "tab\t x\xa0 y\x85", "it's <|endoftext|> here<|endoftext|>",
         "naïve über 東京 🙂🙂", "a" * 3000, "-" * 2000, "ab" * 900, "x \n \n y", "12 345,6",
         "the cat", "the cat"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(FILE)


def test_equals_library_on_random_text(lib):
    rnd, letters = random.Random(5), "aabbceinorst   ' \t\n\t\x1d\x85é<|>end"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(5000)]
    encoder = bpe.Encoder(open(FILE, encoding="utf-8").read())
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert list(memoryview(ids).cast("i")) == lib.encode(text, add_special_tokens=False).ids


def test_round_trip_with_clashing_columns(spark, lib):
    rows = [Row(doc_id=i, text=t, ids="clash", decoded=3) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = bpe.decode(bpe.encode(df, FILE), FILE).orderBy("doc_id").collect()
    for row, text in zip(got, TEXTS, strict=True):
        assert row.ids == lib.encode(text or "", add_special_tokens=False).ids
        assert row.decoded == lib.decode(row.ids, skip_special_tokens=False) == (text or "")


def test_decode_of_odd_ids(spark):
    df = spark.createDataFrame([(None,), ([64, None, -1, 10**6, 65],), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df, FILE).collect()] == ["", "ab", ""]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, FILE).count() == 0


def test_query(spark, data_dir, lib):
    docs = {r.doc_id: r.text or "" for r in
            queries.table(spark, data_dir, "documents").select("doc_id", "text").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = queries.op1_bpe(spark, data_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(",".join(map(str, ids))), sha(docs[r.doc_id]))
