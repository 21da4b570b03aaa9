"""Content-defined fingerprints: chunking rules, shift resistance and the edit query."""

import hashlib
import random

import pytest

from tidemark.llm import fingerprints as fp, queries


def text(seed, n):
    rnd = random.Random(seed)
    return "".join(rnd.choice("abcdefghij éü\n") for _ in range(n))


def slow_ends(data):
    """Chunk ends byte by byte."""
    ends, start = [], 0
    while start < len(data):
        end = min(len(data), start + fp.LARGEST)
        for i in range(start + fp.WINDOW - 1, end - 1):
            h = sum(int(fp.GEAR[data[i - k]]) << k for k in range(fp.WINDOW)) % (1 << 16)
            bits = fp.LOOSE if i + 1 - start >= fp.NORMAL else fp.STRICT
            if h < 1 << 16 - bits:
                end = i + 1
                break
        ends.append(end)
        start = end
    return ends


@pytest.mark.parametrize("n", [0, 1, 16, 17, 40, 3000])
def test_chunk_ends_equal_byte_by_byte(n):
    data = text(n, n).encode()
    assert fp.chunk_ends(data) == slow_ends(data)
    assert fp.chunk_ends(b"a" * n) == slow_ends(b"a" * n)


def test_shift_resistance_and_containment():
    a, b = text(1, 4000), text(2, 4000)
    assert fp.likeness(fp.digest(a), fp.digest("new start " + a)) > 0.95
    assert fp.likeness(fp.digest(a), fp.digest(b + a)) > 0.95
    assert fp.likeness(fp.digest(a), fp.digest(b)) < 0.05
    assert 0.4 < fp.likeness(fp.digest(a), fp.digest(a[:2000] + b[:2000])) < 0.6
    assert fp.likeness(fp.digest(""), fp.digest("")) == 1 and fp.likeness(fp.digest(""), fp.digest(a)) == 0


def expected(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (key, t) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        out[key] = (len(t), t[:len(t) - half] + after[:half], after)
    return out


@pytest.mark.parametrize("size", [3, 10_000])
def test_query(spark, data_dir, monkeypatch, size):
    monkeypatch.setattr(fp, "RANGE_ROWS", size)     # many ranges, and one
    docs = queries.table(spark, data_dir, "documents").select("doc_id", "text")
    want = expected([(r.doc_id, r.text or "") for r in docs.collect()])
    got = queries.edit_likeness(docs).collect()
    assert len(got) == len(want)
    for r in got:
        n, edited, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.edited_fingerprint == fp.digest(edited)
        assert r.near_next == fp.likeness(r.fingerprint, fp.digest(after))
        assert r.near_edited == fp.likeness(r.fingerprint, fp.digest(edited)) and 0 <= r.near_edited <= 1


def test_odd_rows(spark):
    rows = [(5, "abc", 1), (4, None, 1), (3, "", 1), (None, "x" * 50_000, 1), (2, "dup", 1), (2, "dup", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = {(r.doc_id, r.n_chars): r for r in queries.edit_likeness(df).collect()}
    assert len(queries.edit_likeness(df).collect()) == 6
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[5, 3].edited_sha256 == sha("ab") and got[4, 0].edited_sha256 == sha("")
    assert got[None, 50_000].edited_sha256 == sha("x" * 25_000 + "abc")
    assert queries.edit_likeness(df.limit(0)).count() == 0
    assert queries.edit_likeness(df.limit(1)).first().edited_sha256 == sha("aba")
