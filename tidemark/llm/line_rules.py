"""Quality rules with cross-document line frequency.

Each text is measured by rules of its own; its lines are normalised and hashed. A host's distinct
documents that hold a line are counted, lines above the limits are taken out, and a document that
loses too much with them is rejected. Copies of a text on a host are one document in these counts, so
copying does not make its lines boilerplate.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.session import land

SPACE = b" \t\n\x0b\x0c\r"
INSIDE = bytes(range(0x80, 0xC0))       # UTF-8 bytes that begin no character
SYMBOLS = b"#*$%&|<>"
DIGITS = re.compile(r"[0-9]+")
WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
LINE_DOCS = 10              # a line in so many documents of a host, or fewer, always stays
LINE_SHARE = 0.02           # and so does a line in at most this share of a host's documents
DEPLETED = 0.5              # a document that loses more than this share of its words is rejected
SALTS = 16

RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside runs of size words that occur twice or more, the first run included."""
    if len(words) <= size:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    runs = ids
    for more in range(1, size):         # names of runs one word longer, from names of runs
        names = np.unique(runs[:-1] * len(number) + ids[more:], return_inverse=True, return_counts=True)
        runs, counts = names[1], names[2]
    starts = np.flatnonzero(counts[runs] > 1)
    covered = np.zeros(len(words), bool)
    for i in range(size):
        covered[starts + i] = True
    return int(covered.sum())


def line_keys(text: str) -> list[bytes]:
    """Hash of each line, lower-cased, its numbers 0 and its white space single."""
    lines = DIGITS.sub("0", text.lower()).encode().split(b"\n")
    return [xxhash.xxh3_128_digest(b" ".join(x.split())) for x in lines]


def measure(text: str | None) -> tuple:
    """The five measures of a text, its digest, and hash and words of each of its distinct lines."""
    text = text or ""
    raw = text.encode()
    words, lines = raw.split(), raw.split(b"\n")
    sizes = [len(x.split()) for x in lines]
    filled = [x for x, n in zip(lines, sizes) if n]
    found: dict[bytes, int] = {}
    for key, n in zip(line_keys(text), sizes):
        if n:
            found[key] = found.get(key, 0) + n
    return (len(words), len(raw.translate(None, SPACE + INSIDE)), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(filled) - len(set(filled)), repeated_words(words), xxhash.xxh3_128_digest(raw),
            list(found), list(found.values()))


MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "digest binary, lines array<struct<line:binary,words:int>>")


def measures(texts: pa.Array) -> pa.Array:
    rows = [measure(x.as_py()) for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r[6]) for r in rows])]).astype(np.int32)
    lines = pa.StructArray.from_arrays([
        pa.array([x for r in rows for x in r[6]], pa.binary()),
        pa.array([x for r in rows for x in r[7]], pa.int32())], ["line", "words"])
    plain = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(RULES))]
    return pa.StructArray.from_arrays(
        [*plain, pa.array([r[5] for r in rows], pa.binary()), pa.ListArray.from_arrays(offsets, lines)],
        [*RULES, "digest", "lines"])


def frequent_lines(texts: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """host and line of each line above the limits; texts has a row for each host and digest."""
    hosts = texts.groupBy("host").agg(F.count("*").alias("docs"))
    counts = texts.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(
        F.count("*").alias("n")).where(F.col("n") > line_docs)
    return counts.join(hosts, "host").where(F.col("n") > line_share * F.col("docs")).select("host", "line")


def _verdicts(df: DataFrame, id_col, text_col, host_col, line_docs, line_share, depleted):
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    rows = land(df.select(
        F.col(id_col).alias("doc_id"), host.alias("host"), F.monotonically_increasing_id().alias("row"),
        F.arrow_udf(measures, MEASURES)(F.col(text_col)).alias("m")).select("doc_id", "host", "row", "m.*"), "line-rules")
    texts = land(rows.groupBy("host", "digest").agg(
        F.max("n_words").alias("n_words"), F.min("lines").alias("lines")), "line-texts")
    often = frequent_lines(texts, line_docs, line_share)
    # a line in a third of all documents is one join key: its few rows go to every salt
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = texts.select("host", "digest", "n_words", F.explode("lines").alias("l")).select(
        "host", "digest", "n_words", "l.line", "l.words",
        F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int").alias("salt"))
    lost = land(held.join(often, ["host", "line", "salt"]).groupBy("host", "digest", "n_words").agg(
        F.sum("words").alias("lost"), F.collect_list("line").alias("gone")), "lost-lines")
    too_much = (F.col("lost") > depleted * F.col("n_words")) | (F.col("n_words") - F.col("lost") < MIN_WORDS)
    return rows, lost.withColumn("depleted", too_much)


def _salted(rows: DataFrame, by_text: DataFrame) -> DataFrame:
    """rows with what by_text has for their host and digest, a text with many copies spread."""
    by_text = by_text.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", (F.col("row") % SALTS).cast("int"))
    return rows.join(by_text, ["host", "digest", "salt"], "left").drop("salt")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """One row for each row of df: doc_id, the measures of RULES, base_failed and kept.

    base_failed: fewer than MIN_WORDS words, or over REPEAT_PERCENT of them in repeated runs of five.
    A line, lower-cased, its digits and white space evened out, is above the limits if over line_docs
    distinct texts of its host hold it and over line_share of them do; all documents count, failed
    ones too. kept is false for failed documents and for those that lose more than the share depleted
    of their words with such lines, or are left with fewer than MIN_WORDS. Null text is empty; rows
    without host are one host; repeated rows get one verdict each; other columns, of any name, are
    not read. Whole texts are read; the memory of a task follows its longest text.
    """
    rows, lost = _verdicts(df, id_col, text_col, host_col, line_docs, line_share, depleted)
    bad = lost.where("depleted").select("host", "digest", "depleted")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return _salted(rows.drop("lines"), bad).withColumn("base_failed", failed).select(
        "doc_id", *RULES, "base_failed", (~F.col("base_failed") & F.col("depleted").isNull()).alias("kept"))


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """doc_id and text of the rows that judge keeps, without the lines above the limits.

    A text without such lines, a null one too, comes back as it is.
    """
    @F.arrow_udf("string")
    def freed(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for text, keys in zip(texts, gone):
            text, keys = text.as_py(), set(keys.as_py() or ())
            if keys:
                text = "\n".join(x for x, key in zip(text.split("\n"), line_keys(text)) if key not in keys)
            out.append(text)
        return pa.array(out, pa.string())

    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_digest((x.as_py() or "").encode()) for x in texts], pa.binary())

    rows, lost = _verdicts(df, id_col, text_col, host_col, line_docs, line_share, depleted)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    bad = rows.where(failed).select("host", "digest", F.lit(True).alias("bad")).distinct().unionByName(
        lost.where("depleted").select("host", "digest", F.lit(True).alias("bad"))).distinct()
    some = lost.where("not depleted").select("host", "digest", "gone", F.lit(False).alias("bad"))
    verdict = bad.unionByName(some, allowMissingColumns=True).groupBy("host", "digest").agg(
        F.max("bad").alias("bad"), F.min("gone").alias("gone"))
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    whole = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), host.alias("host"),
                      digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    return _salted(whole, verdict).where("not coalesce(bad, false)").select(
        "doc_id", freed("text", "gone").alias("text"))
