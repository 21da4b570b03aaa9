"""How far the sources of a language diverge in their words.

Arrow kernels inside mapInArrow lower, split, dictionary-encode and group the terms of each batch into
partial counts, which Spark adds up. The merged counts of a language are cut into shards of terms;
in a task a shard is a matrix, terms by sources, and gives its part of each divergence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import land

SPLIT = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"      # what stands between terms
MIN_DOCS = 3                # documents of a language that a kept term is in
TOP_TERMS = 200
UNIT = 1_000_000_000        # what probabilities are multiples of
CELLS = 1 << 20             # of a shard's matrix, about
STEP = 1 << 18              # cells worked on at once
BATCH_BYTES = 16 << 20      # of text split at once

COUNTS = "lang string, source string, term string, n long, docs long"


def _counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, term, occurrences and documents of a batch of lang, source and text."""
    langs, sources, texts = (batch.column(i) for i in range(3))
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), SPLIT)
    terms, rows = pc.list_flatten(parts), pc.list_parent_indices(parts)
    some = pc.not_equal(terms, "")
    terms, rows = terms.filter(some).dictionary_encode(), rows.filter(some)
    by_doc = pa.table({"row": rows, "term": terms.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
    place = pa.table({"lang": langs, "source": sources})
    where = [place.column(i).combine_chunks().dictionary_encode() for i in range(2)]
    group = pa.table({"lang": where[0].indices.take(by_doc["row"]), "source": where[1].indices.take(by_doc["row"]),
                      "term": by_doc["term"], "n": by_doc["count_all"]}).group_by(["lang", "source", "term"])
    out = group.aggregate([("n", "sum"), ("n", "count")])
    return pa.RecordBatch.from_arrays([
        where[0].dictionary.take(out["lang"].combine_chunks()), where[1].dictionary.take(out["source"].combine_chunks()),
        terms.dictionary.take(out["term"].combine_chunks()).cast(pa.string()),
        out["n_sum"].combine_chunks().cast(pa.int64()), out["n_count"].combine_chunks().cast(pa.int64())],
        ["lang", "source", "term", "n", "docs"])


def _slices(batch: pa.RecordBatch):
    """The batch in runs of rows with about BATCH_BYTES of text.

    Runs are copies: string kernels have read wrong bytes from parts of a longer array.
    """
    size = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
    run, begin = np.cumsum(size) // BATCH_BYTES, 0
    for end in [*(np.flatnonzero(np.diff(run)) + 1), len(size)]:
        if end > begin:
            yield batch.take(pa.array(range(begin, end), pa.int64()))
        begin = end


def partial_counts(batches):
    for batch in batches:
        for part in _slices(batch):
            yield _counts(part)


def _parts(table: pa.Table) -> pa.Table:
    """A shard's part of the divergence of each source of a language from each other one.

    A shard has a row for each term and source that has it, and a row for each source with the
    probability of the terms it lacks (term null). The sums fit 64 bits: all values of a source
    together are below the square of UNIT and the number of terms.
    """
    lang = table["lang"][0]
    base = table.filter(pc.is_null(table["term"])).sort_by("source")
    cells = table.filter(pc.is_valid(table["term"]))
    sources = base["source"].combine_chunks()
    column = pc.index_in(cells["source"].combine_chunks(), sources).to_numpy()
    terms = cells["term"].combine_chunks().dictionary_encode()
    row, p = terms.indices.to_numpy(), cells["p"].to_numpy()
    order = np.argsort(row, kind="stable")
    row, column, p = row[order], column[order], p[order]
    lacking, n = base["p"].to_numpy(), len(sources)
    total, step = np.zeros((n, n), np.int64), max(1, STEP // n)
    for first in range(0, len(terms.dictionary), step):
        last = min(first + step, len(terms.dictionary))
        a, b = np.searchsorted(row, [first, last])
        matrix = np.repeat(lacking[:, None], last - first, 1)
        matrix[column[a:b], row[a:b] - first] = p[a:b]
        for i in range(n):
            off = matrix[i] - matrix
            total[i] += (off * off // matrix).sum(1)
    left, right = np.divmod(np.arange(n * n), n)
    apart = left != right
    left, right = left[apart], right[apart]
    return pa.table({"lang": pa.repeat(lang, len(left)), "source": sources.take(pa.array(left)),
                     "item": sources.take(pa.array(right)), "value": pa.array(total[left, right])})


def _probability(n, total, kept):
    """1 + floor(UNIT * (n + 1) / (total + kept)), exact beyond 64 bits."""
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(38,0)") * (F.col(n) + 1).cast("decimal(20,0)"),
                                      F.greatest(F.col(total) + F.col(kept), F.lit(1)).cast("decimal(38,0)"))


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: divergences of sources from others and of terms.

    Terms are runs of letters A-Z, lower-cased, and characters above U+007F; a language keeps those in
    at least min_docs of its rows, and every row is a document. A group, the rows of a language and
    source, gives term t the probability p of _probability, and so does the language. Part 'pair' has,
    for each other source of the language, the sum over kept terms of floor((p - q)^2 / q), q its
    probability; 0 if no term is kept. Part 'term' has the top_terms terms with the largest
    floor((p - q)^2 / q) that the group has and uses more than the language does, q the language's.
    Null text, language and source count as ''. Ranks start at 1, ties in the order of items; repeated
    rows count each; other columns, of any name, are not read. No rows give no rows.
    """
    text, lang, source = (F.coalesce(F.col(c), F.lit("")) for c in (text_col, lang_col, source_col))
    rows = df.select(lang.alias("lang"), source.alias("source"), text.alias("text"))
    counts = land(rows.mapInArrow(partial_counts, COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")) \
        .where(F.col("docs") >= min_docs).drop("docs")
    kept = land(counts.drop("docs").join(terms, ["lang", "term"]), "kept-terms")
    terms = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n"))
    langs = land(terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total")), "languages")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.groupBy("lang", "source").agg(F.lit(0).alias("zero")).drop("zero")
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    width = F.count("*").over(Window.partitionBy("lang"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("kept") * width / CELLS))
    groups = land(groups.withColumn("shards", shards), "groups")

    known = kept.join(groups, ["lang", "source"]) \
        .withColumn("p", _probability("n", "total", "kept")) \
        .withColumn("q", _probability("lang_n", "lang_total", "kept"))
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = known.where("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value")) \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    shard = F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard")
    cells = known.select("lang", "source", "term", "p", shard)
    # a language without a kept term has one shard without cells, for its pairs
    lacking = groups.withColumn("n", F.lit(0)).select(
        "lang", "source", F.lit(None).cast("string").alias("term"), _probability("n", "total", "kept").alias("p"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    schema = "lang string, source string, item string, value long"
    parts = cells.unionByName(lacking).groupBy("lang", "shard").applyInArrow(_parts, schema)
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*cols).unionByName(
        top.withColumn("part", F.lit("term")).select(*cols))
