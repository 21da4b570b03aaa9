"""Rules on documents against plain loops."""

import random
import re
from collections import Counter, defaultdict

import duckdb

from tidemark.llm import line_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return " ".join(WORD.findall(re.sub("[0-9]+", "0", line.lower())))


def plain(rows, line_docs, line_share, depleted):
    hosts = defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text or "")
    often = {h: Counter(x for t in texts for x in {normal(ln) for ln in t.split("\n")} if x) for h, texts in hosts.items()}
    for i, text, host in rows:
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        runs = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
        twice = Counter(runs)
        covered = {k + j for k, r in enumerate(runs) if twice[r] > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        gone = [x for x in text.split("\n") if often[host][normal(x)] > line_docs
                and often[host][normal(x)] > line_share * len(hosts[host])]
        lost = sum(len(WORD.findall(x)) for x in gone)
        bad = lost > depleted * len(words) or (lost and len(words) - lost < 10)
        left = "\n".join(x for x in text.split("\n") if x not in gone)
        yield (i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
               len(covered), failed, not failed and not bad), left


def corpus():
    rnd = random.Random(3)
    vocabulary = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(400)] + ["É#", "a*b", "$", "ß"]
    menu = ["Home  About\tus 2024", "All rights reserved 1999", "read more read more read more now please"]
    rows = []
    for i in range(400):
        lines = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 12))) for _ in range(rnd.randint(1, 8))]
        lines += [re.sub("[0-9]+", str(rnd.randrange(99)), x) for x in menu if rnd.random() < 0.3]
        if rnd.random() < 0.1:
            lines += lines[:2]
        rnd.shuffle(lines)
        rows.append((i, rnd.choice(["\n", "\r\n", "\n \n"]).join(lines), rnd.choice(["a", "a", "b", None, ""])))
    rows += [(1000 + i, rows[5][1], "a") for i in range(60)] + [rows[6]] * 40
    return rows + [(2000, None, "a"), (2001, "", None), (2002, "  \n\t", "c"), (None, "one " * 9, "a"),
                   (2003, "x y z\n" * 30_000, "b"), (2004, " ".join(f"q{i}" for i in range(200_000)), "b")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows],
                                 "doc_id long, text string, source string, row int, digest int, lines int")


def test_equals_plain_loops(spark):
    rows = corpus()
    want = list(plain(rows, 10, 0.05, 0.3))
    got = line_rules.judge(frame(spark, rows), line_share=0.05, depleted=0.3).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((w for w, _ in want), key=repr)
    assert 20 < sum(not w[-1] and not w[-2] for w, _ in want) < len(rows) - 20
    freed = line_rules.clean(frame(spark, rows), line_share=0.05, depleted=0.3).collect()
    texts = {id_: text for id_, text, _ in rows}
    assert sorted((repr(r.doc_id), r.text) for r in freed) == sorted(
        (repr(w[0]), left) for w, left in want if w[-1])
    assert any(r.text != texts[r.doc_id] for r in freed)


def test_copies_of_a_text_are_one_document(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(8)) for i in range(5))
    rows = [(i, text, "a") for i in range(100)]
    assert all(r.kept for r in line_rules.judge(frame(spark, rows)).collect())


def test_empty_table(spark):
    assert line_rules.judge(frame(spark, [])).count() == 0 and line_rules.clean(frame(spark, [])).count() == 0


def test_query_equals_sql(spark, data_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data_dir}/documents.parquet'")
    want = con.execute(queries.SQL["op11_line_rules"]).fetchall()
    got = [tuple(r) for r in queries.op11_line_rules(spark, data_dir).collect()]
    assert sorted(got) == sorted(want)
