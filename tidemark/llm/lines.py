"""Line dedup by winnowing over line hashes.

A window is the shortest stretch of whole lines, forwards or backwards from a line, that holds
min_words words; its fingerprint is the smallest line hash in it. A run of at least so many words
that stands in two places has the same windows, hence the same fingerprints, in both. Windows whose
fingerprint was selected in one place only are put aside; the others are joined by their whole
content with the first place that has them. The windows that start at a line and those that end
there extend a match both ways: together they cover just the repeated runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.mixing import words
from tidemark.session import land

DOC = ("doc_id", "digest")


def _lines(docs: DataFrame) -> DataFrame:
    """Hash, word count and number of each line that has words; rows of equal id and text once."""
    lines = docs.select(*DOC, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(
        *DOC, "line_no", F.xxhash64("line").alias("hash"), words("line").alias("words"))
    return lines.where("words > 0").repartition(*DOC).dropDuplicates([*DOC, "line_no"])


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Both windows of each line: first and last line, content key, fingerprint and its line."""
    doc = Window.partitionBy(*DOC)
    upto = F.sum("words").over(doc.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("end", upto).withColumn("start", F.col("end") - F.col("words"))
    ahead = doc.orderBy("start").rangeBetween(0, min_words - 1)
    back = doc.orderBy("end").rangeBetween(-(min_words - 1), 0)

    def window(frame) -> Column:
        return F.struct(
            (F.sum("words").over(frame) >= min_words).alias("full"),
            F.min("line_no").over(frame).alias("first"), F.max("line_no").over(frame).alias("last"),
            F.xxhash64(F.collect_list("hash").over(frame)).alias("content"),
            F.min(F.struct("hash", "line_no")).over(frame).alias("fingerprint"))

    both = lines.withColumns({"ahead": window(ahead), "back": window(back)})
    both = both.select(*DOC, F.explode(F.array("ahead", "back")).alias("w"))
    return both.where("w.full").select(
        *DOC, "w.first", "w.last", "w.content",
        F.col("w.fingerprint.hash").alias("fingerprint"), F.col("w.fingerprint.line_no").alias("at"))


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, digest of the text, and first and last line of each later repeated run.

    A run of whole lines counts if it has min_words words and stands earlier too: in a document
    before by doc_id (null last) or before in the same one. Rows of equal id and text are one document.
    """
    windows = land(_windows(_lines(docs), min_words), "line-windows")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), *DOC, "at")
    chosen = windows.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    chosen = chosen.where("a != b").select("fingerprint")
    # the places of one window content by order; the first keeps its lines
    start = F.struct(F.col("doc_id").isNull().alias("unknown"), *DOC, "first")
    windows = windows.join(chosen, "fingerprint", "left_semi")
    firsts = windows.groupBy("content").agg(F.min(start).alias("a"), F.max(start).alias("b"))
    later = windows.join(firsts.where("a != b").select("content", "a"), "content").where(start > F.col("a"))
    gone = later.select(*DOC, F.explode(F.sequence("first", "last")).alias("line_no")).distinct()
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(*DOC).orderBy("line_no"))
    return gone.withColumn("island", island).groupBy(*DOC, "island").agg(
        F.min("line_no").alias("first"), F.max("line_no").alias("last")).drop("island")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = 50, removed_col: str = "removed_lines") -> DataFrame:
    """The rows of docs, their texts without the lines of later repeated runs, and how many these were.

    See repeated_runs; a column named removed_col is replaced. A text of which nothing is left is
    empty; null stays null; texts without repeats keep every byte.
    """
    whole = F.struct(*[c for c in docs.columns if c != removed_col]).alias("row")
    keyed = docs.select(whole, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.xxhash64(text_col).alias("digest"))
    runs = land(repeated_runs(keyed.select(*DOC, "text"), min_words), "line-runs")
    runs = runs.groupBy(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest")).agg(
        F.collect_list(F.struct("first", "last")).alias("runs"))
    # one plan at every size, whether or not the runs would fit a broadcast
    joined = keyed.join(runs.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_id"))
                        & (F.col("digest") == F.col("of_digest")), "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.exists(
        "runs", lambda r: (r["first"] <= i) & (i <= r["last"])))
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col("row")[c].alias(c)
          for c in docs.columns if c != removed_col],
        F.coalesce(removed, F.lit(0)).alias(removed_col))
