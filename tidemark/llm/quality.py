"""Quality classifier: document evidence with host and path priors by hierarchical empirical Bayes.

Labelled documents give a log-likelihood ratio to each bin of a few text measures; their sum is a
document's evidence. Over all documents, labelled or not, the evidence is averaged by path and by
host; sparse paths shrink towards their host and sparse hosts towards the global mean, as strongly
as the spread between them says. A document's posterior is its evidence on the prior of its path
without itself. Everything is a map-side-combined aggregate; the driver sees one row a measure bin
and the strengths of the two levels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.mixing import WORD, words
from tidemark.session import land

BINS = 16
MEASURES = 8
MOST_EVIDENCE = 20.0


def measures(text: Column) -> Column:
    """Bins of the text measures, null for a text without words."""
    chars, n = F.length(text), words(text)
    parts = F.filter(F.regexp_extract_all(text, F.lit(f"({WORD})")), lambda w: w != "")
    shares = [
        F.regexp_count(text, F.lit("[^\\p{L}\\p{N}\\s.,;:!?'\"()-]")) / chars,     # odd symbols
        F.regexp_count(text, F.lit("\\p{Lu}")) / chars,
        F.regexp_count(text, F.lit("[!?*#$%&|]{2,}|\\|")) / n,                    # runs of marks
        F.regexp_count(text, F.lit("\\p{N}")) / chars,
        F.size(F.array_distinct(parts)) / n,
        F.least(F.lit(1.0), chars / n / 20),
        F.least(F.lit(1.0), F.log2(n + 1) / 16) ** 2,
        F.regexp_count(text, F.lit("\n")) / n,
    ]
    bins = [F.least(F.lit(BINS - 1), F.floor(BINS * F.sqrt(s))).cast("int") for s in shares]
    return F.when(n > 0, F.array(*bins))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
             path_col: str = "lang") -> DataFrame:
    """doc_id, host, path and bins of each row, and the row itself as a struct."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"),
        measures(F.col(text_col)).alias("bins"), F.struct(*docs.columns).alias("row"))


@dataclass(frozen=True)
class Model:
    prior: float            # log odds of a good document
    ratios: list            # log-likelihood ratio by measure and bin
    sites: DataFrame        # host, path, their posteriors, sums and counts

    def evidence(self) -> Column:
        tables = [F.element_at(F.array(*map(F.lit, r)), F.col("bins")[i] + 1) for i, r in enumerate(self.ratios)]
        total = F.greatest(F.lit(-MOST_EVIDENCE), F.least(F.lit(MOST_EVIDENCE), sum(tables[1:], tables[0])))
        return F.when(F.col("bins").isNotNull(), total)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Weight of the prior mean, in documents, by the spread between groups beyond that by chance."""
    m = F.col("sum") / F.col("n")
    spread, within, n, count = groups.agg(
        F.sum(F.col("n") * (m - mean) ** 2), F.sum(F.col("n") * m * (1 - m)), F.sum("n"), F.count("*")).first()
    if not n:
        return 1.0
    within /= n
    between = max(0.0, (spread - count * within) / n)
    return min(1e6, max(1.0, within / between)) if between else 1e6


def fit(feats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Learns from feats, a landed table of measured rows, and labels with doc_id and label_col.

    All labelled documents count; several labels of a document count as their mean. Without labels
    of both kinds there is no evidence, and every document is as likely good as not.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy("doc_id").agg((F.avg(label_col) >= 0.5).alias("good"))
    counts = feats.where("bins is not null").join(known, "doc_id").select(
        "good", F.posexplode("bins").alias("measure", "bin"))
    cells = counts.groupBy("measure", "bin").agg(F.count_if("good").alias("good"), F.count("*").alias("n"))
    cells = cells.collect()     # at most measures times bins
    good = sum(r.good for r in cells if r.measure == 0)
    bad = sum(r.n for r in cells if r.measure == 0) - good
    ratios = [[0.0] * BINS for _ in range(MEASURES)]
    for r in cells if good and bad else ():
        ratios[r.measure][r.bin] = math.log((r.good + 1) / (good + BINS)) - math.log(
            (r.n - r.good + 1) / (bad + BINS))
    prior = math.log(good / bad) if good and bad else 0.0
    model = Model(prior, ratios, feats)
    scored = feats.where("bins is not null").select(
        "host", "path", _sigmoid(prior + model.evidence()).alias("p"))
    paths = land(scored.groupBy("host", "path").agg(F.sum("p").alias("sum"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("sum"), F.sum("n")).first()
    mean = total[0] / total[1] if total[1] else 0.5
    k_host = _strength(hosts, F.lit(mean))
    hosts = hosts.select(
        F.col("host").alias("h"), ((k_host * mean + F.col("sum")) / (k_host + F.col("n"))).alias("host_quality"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = _strength(sites, F.col("host_quality"))
    sites = land(sites.select(
        F.col("host").alias("h"), F.col("path").alias("p"), "sum", "n", "host_quality",
        F.lit(k_path).alias("strength")), "sites")
    return Model(prior, ratios, sites)


def classify(feats: DataFrame, model: Model) -> DataFrame:
    """Adds evidence, host_quality, path_quality, quality (0 to 1) and keep (quality of a half or more).

    Texts without words, null ones too, have quality 0 and are not kept.
    """
    own = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    joined = feats.withColumn("evidence", model.evidence()).join(model.sites, own, "left")
    alone = _sigmoid(model.prior + F.col("evidence"))
    prior = (F.col("strength") * F.col("host_quality") + F.col("sum") - alone) / (
        F.col("strength") + F.col("n") - 1)
    prior = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), prior))
    quality = _sigmoid(F.col("evidence") + F.log(F.col("path_quality") / (1 - F.col("path_quality"))))
    return joined.withColumn("path_quality", prior).withColumn(
        "quality", F.coalesce(quality, F.lit(0.0))).withColumn("keep", F.col("quality") >= 0.5 - 1e-9) \
        .drop("h", "p", "sum", "n", "strength", "bins")
