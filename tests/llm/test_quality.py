"""Quality classifier: held-out accuracy, shrinkage against plain Python, and odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    got = queries.quality_scores(docs, labels.where("doc_id % 2 = 0")).cache()
    assert got.count() == docs.count()
    held = got.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = [r.keep == bool(r[6]) for r in held]
    clean = [r.keep for r in held if r[6] == 1]
    assert sum(right) / len(right) > 0.95 and sum(clean) / len(clean) > 0.97


def plain(rows, prior, table):
    """Posteriors with loops: rows of (host, path, evidence)."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    p = [sig(prior + e) for _, _, e in rows]

    def strength(groups, mean):
        n = sum(len(g) for g in groups.values())
        within = sum(len(g) * (sum(g) / len(g)) * (1 - sum(g) / len(g)) for g in groups.values()) / n
        spread = sum(len(g) * (sum(g) / len(g) - mean(k)) ** 2 for k, g in groups.items())
        between = max(0.0, (spread - len(groups) * within) / n)
        return min(1e6, max(1.0, within / between)) if between else 1e6

    hosts, paths = {}, {}
    for (h, q, _), x in zip(rows, p):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, q), []).append(x)
    mean = sum(p) / len(p)
    k = strength(hosts, lambda _: mean)
    host = {h: (k * mean + sum(g)) / (k + len(g)) for h, g in hosts.items()}
    k = strength(paths, lambda key: host[key[0]])
    out = []
    for (h, q, e), x in zip(rows, p):
        g = paths[h, q]
        path = min(1 - 1e-6, max(1e-6, (k * host[h] + sum(g) - x) / (k + len(g) - 1)))
        out.append((host[h], path, sig(e + math.log(path / (1 - path)))))
    return out


def test_shrinkage_equals_plain_python(spark, data_dir):
    docs, labels = queries.table(spark, data_dir, "documents"), queries.table(spark, data_dir, "labels")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 9 > 0, F.col("lang"))).unionByName(docs.limit(3))
    feats = quality.land(quality.measured(docs).drop("row"), "t")
    model = quality.fit(feats, labels)
    got = quality.classify(feats, model).collect()
    want = plain([(r.host, r.path, r.evidence) for r in got], model.prior, None)
    for r, w in zip(got, want, strict=True):
        assert (r.host_quality, r.path_quality, r.quality) == pytest.approx(w, abs=1e-9)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "a", "p"), (3, "Good words here.", "a", "p"), (3, "Good words here.", "a", "p"),
            (None, "x*** " * 9000, None, "p")]
    docs = spark.createDataFrame([(*r, 9) for r in rows],
                                 "doc_id long, text string, source string, lang string, quality int")
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 0)], "doc_id long, quality int")
    got = queries.quality_scores(docs, labels).collect()
    assert sorted((r.doc_id or 0, r.keep) for r in got) == [(0, True), (1, False), (2, False), (3, True), (3, True)]
    assert queries.quality_scores(docs.limit(0), labels).count() == 0
    assert queries.quality_scores(docs, labels.limit(0)).count() == 5
