"""From raw documents to token ids: stages applied in order, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import lines, mixing, near, quality, queries
from tidemark.session import land

#: Hashes, signatures and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, keeps."""
    feats = quality.measured(docs)
    model = quality.fit(land(feats.drop("row"), "measures"), queries.table(spark, sf_dir, "labels"))
    return quality.classify(feats, model).where("keep").select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; n_chars follows the text."""
    return lines.dedup_lines(docs).drop("removed_lines").withColumn(
        "n_chars", F.length("text").cast("long"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash groups and min-hash bands, verified."""
    return near.near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the schedule.

    A copy stands where its first words are scheduled. Where the mix stops inside a document, the row
    has only the words taken; n_chars follows the text.
    """
    # one row a copy: a repeated row is told from its like by where it begins in the stream
    blocks = mixing.schedule(docs).withColumn("of", F.col("stream_at") - F.col("begin"))
    taken = blocks.groupBy("key", "source", "pass_no", "of").agg(
        F.min("slot").alias("slot"), F.sum("words").alias("words"))
    taken = land(taken.select("key", "slot", "words"), "copies")
    rows = docs.groupBy(mixing.row_key().alias("key")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    text, words = F.col("row.text"), F.col("words")
    pieces = F.regexp_extract_all(
        text, F.lit("(?:^[\\x20\\x09-\\x0D]+)?" + mixing.WORD + "[\\x20\\x09-\\x0D]*"), F.lit(0))
    cut = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), ""),
                           "[\\x20\\x09-\\x0D]+$", "")
    rows = rows.join(taken.hint("merge"), "key").withColumn("whole", words >= mixing.words(text)) \
        .withColumn("cut", F.when(F.col("whole"), text).otherwise(cut))
    return rows.orderBy("slot").select(*[
        F.col("cut").alias(c) if c == "text" else
        F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length("cut")).alias(c) if c == "n_chars" else
        F.col(f"row.{c}").alias(c) for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of what they decode to."""
    return queries.bpe_digests(docs)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), name)
    return docs
