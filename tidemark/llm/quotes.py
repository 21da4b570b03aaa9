"""Chat formatting by quotation linking.

The lines of a message are parsed into passages of one quote level each. Quoted passages and their
parts are normalised and hashed, and joined to the messages whose own words have the same hashes; the
message that most of a quotation is from is the one replied to. Replies then form trees, written in reply order without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import land

MARKS = "^((?:[ \\t]*>)+)[ \\t]?"     # the quote marks that begin a line
STRETCH = 4_096             # turns of a conversation that are ordered in one place


def with_passages(df: DataFrame, text_col: str, out_col: str = "passages") -> DataFrame:
    """Adds the runs of lines of one quote level, in order: structs of level and text; none for null.

    The level is the number of '>' a line begins with, white space between them allowed. Marks and
    one space after them are taken off; white space around a passage is dropped, and empty passages.
    Lines and beginnings of runs are columns of their own, so that a message is read once however many
    lines it has. A column out_col is replaced.
    """
    lines, starts = F.col("__lines"), F.col("__starts")
    df = df.withColumn("__lines", F.transform(F.split(F.col(text_col), "\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"),
        F.regexp_replace(x, MARKS, "").alias("line"))))
    df = df.withColumn("__starts", F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (
        F.get(lines, i)["level"] != F.get(lines, i - 1)["level"])))
    runs = F.transform(starts, lambda s, k: F.struct(
        F.get(lines, s)["level"].alias("level"),
        F.regexp_replace(F.array_join(F.transform(
            F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s),
            lambda x: x["line"]), "\n"), "^\\s+|\\s+$", "").alias("text")))
    none = F.array().cast("array<struct<level:int,text:string>>")
    return df.withColumn(out_col, F.coalesce(F.filter(runs, lambda r: r["text"] != ""), none)).drop(
        "__lines", "__starts")


def normal(text: Column) -> Column:
    """A text with white space evened out and letters lowered."""
    return F.lower(F.trim(F.regexp_replace(text, "\\s+", " ")))


def pieces(passage: Column) -> Column:
    """What of a passage can be quoted: the whole, its paragraphs and its lines, normalised."""
    whole = F.array(passage)
    parts = F.flatten(F.array(whole, F.split(passage, "\n\\s*\n"), F.split(passage, "\n")))
    return F.filter(F.array_distinct(F.transform(parts, normal)), lambda x: x != "")


def _sources(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """quoted (conv_id, key, turn, level, weight) with source, the last turn before it that has the key
    in own (conv_id, key, turn).

    Turns are cut into stretches, so that a line that stands in every message of a long conversation
    is not sorted in one task.
    """
    stretch = F.floor(F.col("turn") / STRETCH).alias("stretch")
    events = own.select("conv_id", "key", "turn", stretch, F.lit(1).alias("last"),
                        F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("weight")).unionByName(
        quoted.select("conv_id", "key", "turn", stretch, F.lit(0).alias("last"), "level", "weight"))
    mine = F.when(F.col("last") == 1, F.col("turn"))
    here = Window.partitionBy("conv_id", "key", "stretch").orderBy("turn", "last").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id", "key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = events.groupBy("conv_id", "key", "stretch").agg(F.max(mine).alias("final")).withColumn(
        "earlier", F.last("final", ignorenulls=True).over(before)).where("earlier is not null").drop("final")
    found = events.withColumn("here", F.last(mine, ignorenulls=True).over(here)).where("level is not null")
    return found.join(earlier, ["conv_id", "key", "stretch"], "left").select(
        "conv_id", "turn", "level", "weight", F.coalesce("here", "earlier").alias("source")).where("source is not null")


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text",
         role_col: str = "role") -> DataFrame:
    """One row for each message: conv_id, turn, role, text without quotes, parent, root, depth.

    Own and quoted passages are hashed whole, by paragraph and by line, so quotations that are
    trimmed or answered line by line are found too. Each quoted piece speaks, with its length, for the
    last message before it in the conversation that has the piece among its own words. A message
    answers the one most is said for at the lowest quote level that finds any; of several, the last.
    parent is that turn, null for messages that answer none; root is the turn its thread begins with
    and depth the replies between them. Ordered by root, depth and turn, every message follows the one
    it answers. Rows without conversation or turn answer none; repeated rows are messages of their
    own. Null text stays null; texts of any length are read once; other columns, of any name, are not
    read, and an empty table gives none.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.col(text_col).isNull().alias("no_text"), F.col(text_col).alias("text"))
    parsed = land(with_passages(rows, "text").drop("text"), "passages")
    known = parsed.where("conv_id is not null and turn is not null")
    parts = known.select("conv_id", "turn", F.explode("passages").alias("passage")).select(
        "conv_id", "turn", "passage.level", F.explode(pieces(F.col("passage.text"))).alias("piece"))
    parts = parts.select("conv_id", "turn", "level", F.xxhash64("piece").alias("key"), F.length("piece").alias("weight"))
    own = parts.where("level = 0").select("conv_id", "key", "turn").distinct()
    votes = _sources(own, parts.where("level > 0").distinct()).groupBy("conv_id", "turn", "level", "source").agg(
        F.sum("weight").alias("said"))
    parents = land(votes.groupBy("conv_id", "turn").agg(F.min(F.struct(
        "level", (-F.col("said")).alias("said"), (-F.col("source")).alias("order"), "source"))["source"].alias(
        "parent")), "replies")
    roots = threads(parents)
    own_text = F.array_join(F.transform(
        F.filter("passages", lambda p: p["level"] == 0), lambda p: p["text"]), "\n\n")
    return parsed.join(parents, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.when(~F.col("no_text"), own_text).alias("text"), "parent",
        F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))


def threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, root and depth of each reply, from columns conv_id, turn, parent.

    A reply's parent comes before it, so jumps that double in length reach every root in as many
    rounds as the logarithm of the longest chain. The driver sees a row a round.
    """
    now = parents.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth"))
    while True:
        now = land(now, "threads")
        above = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"),
                           F.col("depth").alias("more"))
        if now.join(above, ["conv_id", "root"], "left_semi").isEmpty():
            return now
        now = now.join(above, ["conv_id", "root"], "left").select(
            "conv_id", "turn", F.coalesce("next", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
