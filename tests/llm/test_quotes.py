"""Quotation linking: parsing, threads against loops, and the query on derived mail."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest

from tidemark.llm import queries, quotes


def rows_of(spark, messages):
    df = spark.createDataFrame([(*m, 1, 2) for m in messages],
                               "conv_id long, turn int, role string, text string, parent int, key int")
    return {(r.conv_id, r.turn): r for r in quotes.link(df).collect()}


MARKS = re.compile(r"((?:[ \t]*>)+)[ \t]?")


def plain_passages(text):
    out = []
    for line in text.split("\n") if text is not None else []:
        m = MARKS.match(line)
        level, line = (m.group(1).count(">"), line[m.end():]) if m else (0, line)
        if not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(line)
    return [(k, t) for k, t in ((k, "\n".join(x).strip()) for k, x in out) if t]


def plain_links(messages):
    """Parent of each (conv, turn), all pairs of messages compared."""
    def pieces(text):
        units = [text, *re.split(r"\n\s*\n", text), *text.split("\n")]
        return {u for u in (" ".join(x.split()).lower() for x in units) if u}

    parsed = {(c, t): plain_passages(x) for c, t, _, x in messages}
    own = {k: {u for level, t in ps if level == 0 for u in pieces(t)} for k, ps in parsed.items()}
    parents = {}
    for (conv, turn), ps in parsed.items():
        said = Counter()
        for level, unit in {(level, u) for level, t in ps if level for u in pieces(t)}:
            before = [t for (c, t), units in own.items() if c == conv and t < turn and unit in units]
            if before:
                said[level, max(before)] += len(unit)
        parents[conv, turn] = min(((level, -n, -t) for (level, t), n in said.items()), default=(0, 0, None))[2]
        if parents[conv, turn] is not None:
            parents[conv, turn] *= -1
    return parents


def test_passages(spark):
    text = "Hi all,\n\n> one\n>  two\n> > deep\n>> deeper still\nmine\n\nmore\n>\n> "
    texts = [text, None, "", "> only"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, passages int")
    got = [[tuple(p) for p in r.passages] for r in quotes.with_passages(df, "text").collect()]
    assert got[0] == [(0, "Hi all,"), (1, "one\n two"), (2, "deep\ndeeper still"), (0, "mine\n\nmore")]
    assert got == [plain_passages(t) for t in texts]


def test_very_long_message_is_read_in_linear_time(spark):
    text = "\n".join(">" * (i % 3) + f" line {i}" for i in range(20_000))
    df = spark.createDataFrame([(1, 0, "a", text.replace(">", "")), (1, 1, "b", text)],
                               "conv_id long, turn int, role string, text string")
    quotes.with_passages(df.limit(0), "text").collect()
    begin = time.time()
    sizes = [len(r.passages) for r in quotes.with_passages(df, "text").collect()]
    assert sizes == [1, 20_000] and time.time() - begin < 5
    assert {r.turn: r.parent for r in quotes.link(df).collect()} == {0: None, 1: 0}


@pytest.mark.parametrize("stretch", [4096, 2])
def test_equals_comparison_of_all_messages(spark, monkeypatch, stretch):
    monkeypatch.setattr(quotes, "STRETCH", stretch)
    rnd, messages = random.Random(4), []
    pool = ["Yes.", "No way", "see  below", "Thanks!", "", "one more thing"]
    for conv in range(12):
        said = []
        for turn in range(rnd.randint(1, 14)):
            own = [rnd.choice(pool) if rnd.random() < 0.4 else f"Line {rnd.randrange(40)} of talk" for _ in range(rnd.randint(1, 5))]
            quoted = []
            for _ in range(rnd.randint(0, 2)):
                if said:
                    old = rnd.choice(said)
                    a = rnd.randrange(len(old))
                    quoted += [">" * rnd.randint(1, 3) + " " + x.upper() for x in old[a:a + rnd.randint(1, 4)]]
                    if rnd.random() < 0.5:
                        quoted.append(rnd.choice(pool))
            said.append(own)
            messages.append((conv, turn, "r", "\n".join(quoted + own)))
    want = plain_links(messages)
    got = rows_of(spark, messages)
    assert {k: r.parent for k, r in got.items()} == want and sum(p is not None for p in want.values()) > 30
    for (conv, turn), r in got.items():
        depth, at = 0, turn
        while want[conv, at] is not None:
            depth, at = depth + 1, want[conv, at]
        assert (r.root, r.depth) == (at, depth)


def test_links_and_threads(spark):
    got = rows_of(spark, [
        (1, 0, "a", "Where is the key?"),
        (1, 1, "b", "> where  is the KEY?\nUnder the mat."),
        (1, 2, "c", ">> Where is the key?\n> Under the mat.\nThanks."),
        (1, 3, "d", "> Where is the key?\nIn the car."),
        (1, 4, "e", "> never written\nOdd."),
        (1, 5, "f", "> In the car.\n> no such line\nOdd too."),
        (2, 0, "a", "Under the mat."), (2, 1, "b", None), (2, 2, "c", ""),
        (None, 3, "x", "> Thanks.\ny"), (3, None, "x", "z")])
    link = {k: (r.parent, r.root, r.depth) for k, r in got.items()}
    assert link[1, 0] == (None, 0, 0) and link[1, 1] == (0, 0, 1) and link[1, 2] == (1, 0, 2)
    assert link[1, 3] == (0, 0, 1) and link[1, 4] == (None, 4, 0)
    assert link[1, 5] == (3, 0, 2)          # one of two quoted lines is known
    assert got[1, 2].text == "Thanks." and got[2, 1].text is None and got[2, 2].text == ""
    assert got[None, 3].text == "y" and got[3, None].root is None


def test_long_chain_and_repeated_rows(spark):
    chain = [(1, i, "r", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(40)]
    got = rows_of(spark, chain)
    assert [got[1, i].depth for i in range(40)] == list(range(40)) and got[1, 39].root == 0
    df = spark.createDataFrame(chain[:2] * 2, "conv_id long, turn int, role string, text string")
    assert sorted(r.turn for r in quotes.link(df).collect()) == [0, 0, 1, 1]
    assert quotes.link(df.limit(0)).count() == 0


def test_query(spark, data_dir):
    turns = queries.table(spark, data_dir, "conversations")
    mail = [tuple(r) for r in queries.as_replies(turns).collect()]
    want, said = plain_links(mail), {(c, t): x for c, t, _, x in mail}
    got = {(r.conv_id, r.turn): r for r in queries.op8_quotation_linking(spark, data_dir).collect()}
    assert len(got) == len(mail) == turns.count()
    assert {k: r.parent for k, r in got.items()} == want
    assert all(want[c, t] == t - 1 for c, t in want if t)
    for (conv, turn), r in got.items():
        own = "\n\n".join(t for level, t in plain_passages(said[conv, turn]) if level == 0)
        assert (r.root, r.depth) == (0, turn) and r.text_sha256 == hashlib.sha256(own.encode()).hexdigest()
