"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Slots 0, 1, 2, ... are mapped through a golden-ratio sequence onto the cumulative shares of the
sources, so every stretch of the schedule is close to the mix. The k-th slot of a source takes the
k-th block of its shuffled word stream, beginning again after the last one. Positions in streams
and ranks of slots are sums over buckets plus a sum inside a bucket: no source, however large, is
put in order by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import land

WORD = "[^\\x20\\x09-\\x0D]+"
PERIOD, GOLDEN = 1 << 31, 1_327_217_885     # the multiplier is the period by the golden ratio
BUCKET_ROWS, CHUNK_SLOTS = 4_000, 8_192


def words(text) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Row number, size and target of each source in a table with columns source, size.

    Sources in code point order, null last, get the weights in turn. The total is share times all
    sizes; a target above most times the source's size stops there, and the excess goes to the others
    by weight until none is above. One row a source, so these windows see a row a source.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    everything, rest = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    rest = rest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(w) - 1, F.lit(len(weights)))
    sources = sources.select(
        "*", F.row_number().over(w).alias("sid"), (most * F.col("source_size")).alias("cap"),
        F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double").alias("weight"))
    left = share * F.sum("source_size").over(everything) - (
        F.sum("cap").over(everything) - F.sum("cap").over(rest))
    level = sources.withColumn("level", left / F.sum("weight").over(rest))
    level = level.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    # from the first source that is not capped on, all share at its level
    common = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "sid", "level")))
    return level.withColumn("common", common.over(everything)["level"]).select(
        "sid", "source", "docs", "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("common")).alias("target"),
    )


def slots(sources: DataFrame, block: int) -> DataFrame:
    """slot, sid, pass_no, block_no, until: each block the mix takes and the stream position where it stops.

    Slots order the blocks of the mix; their numbers are distinct but leave gaps. sources is the table
    of targets. It is collected: a row a source. What the schedule still owes a source at its end,
    some slots at most, follows after it.
    """
    spark = sources.sparkSession
    rows = [r for r in sources.orderBy("sid").collect() if int(r.target) > 0]
    plan, total = [], sum(r.target for r in rows)
    for r in rows:
        blocks, passes = -(-r.source_size // block), int(r.target) // r.source_size
        last = int(r.target) - passes * r.source_size
        plan.append((r.sid, r.source_size, blocks, last, passes * blocks + -(-last // block)))
    need = spark.createDataFrame(plan, "sid int, size long, blocks long, last long, need long")
    if not plan:
        return need.select(F.col("need").alias("slot"), "sid", *[
            F.col("need").alias(c) for c in ("pass_no", "block_no", "until")])
    edges, upto = [], 0.0
    for r in rows[:-1]:
        upto += r.target / total
        edges.append(round(upto * PERIOD))
    numbers = F.array(*[F.lit(r.sid) for r in rows])
    point = F.pmod(F.pmod("id", F.lit(PERIOD)) * GOLDEN, F.lit(PERIOD))
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<long>"),
                            lambda e: e <= F.col("point")))
    length, most_sid = sum(p[-1] for p in plan), max(p[0] for p in plan)
    drawn = spark.range(length).withColumn("point", point).select(
        "id", F.element_at(numbers, place + 1).alias("sid"),
        F.floor(F.col("id") / CHUNK_SLOTS).alias("chunk"))
    counts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    counts = land(counts, "slot-counts")
    before = Window.partitionBy("sid").orderBy("chunk")
    starts = counts.withColumn("start", F.sum("n").over(before) - F.col("n")).drop("n")
    inside = Window.partitionBy("sid", "chunk").orderBy("id")
    ranked = drawn.withColumn("k", F.row_number().over(inside) - 1).join(starts, ["sid", "chunk"]) \
        .select("id", "sid", (F.col("k") + F.col("start")).alias("k"))
    owed = need.join(counts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left") \
        .withColumn("n", F.coalesce("n", F.lit(0))).where("n < need") \
        .select("sid", "n", F.explode(F.sequence("n", F.col("need") - 1)).alias("k")) \
        .select((length + (F.col("k") - F.col("n")) * most_sid + F.col("sid") - 1).alias("id"), "sid", "k")
    end = F.least((F.col("block_no") + 1) * block, "size")
    return ranked.unionByName(owed).join(need, "sid").where("k < need").select(
        F.col("id").alias("slot"), "sid", "size", "k", "need", "last",
        F.floor(F.col("k") / F.col("blocks")).alias("pass_no"), F.pmod("k", "blocks").alias("block_no"),
    ).select("slot", "sid", "pass_no", "block_no", F.when((F.col("k") == F.col("need") - 1) & (F.col("last") > 0),
                                       F.least(end, "last")).otherwise(end).alias("until"))


def row_key(source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> Column:
    """Hash of a document's row: its place in the shuffled order, and its name in the schedule."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col))


def _parts(docs: DataFrame, source_col: str, text_col: str, id_col: str, weights, share: float,
           most: float, block: int) -> DataFrame:
    """Words begin to end, positions in the source's stream, of each document in each slot; slot is
    null where the mix takes no such block. first is where the document begins."""
    text, key = F.col(text_col), row_key(source_col, text_col, id_col)
    sizes = land(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text).alias("size"),
        key.alias("key")), "sizes")
    sources = land(targets(sizes, weights, share, most), "targets")
    buckets = F.lit(max(1, sizes.count() // BUCKET_ROWS))
    rows = sizes.join(
        sources.select("sid", F.col("source").alias("s"), "source_size", "target"),
        F.col("source").eqNullSafe(F.col("s")),
    ).withColumn("bucket", F.pmod("key", buckets))
    order = Window.partitionBy("sid").orderBy("bucket")
    starts = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    starts = starts.withColumn("start", F.sum("n").over(order) - F.col("n")).drop("n")
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumns({"upto": upto, "place": F.row_number().over(inside)})
    placed = placed.join(starts, ["sid", "bucket"]).select(
        "doc_id", "source", "key", "size", "source_size", "target", "sid", "bucket", "place",
        (F.col("start") + F.col("upto") - F.col("size")).alias("first"))
    blocks = F.sequence(F.floor(F.col("first") / block),
                        F.floor((F.col("first") + F.greatest("size", F.lit(1)) - 1) / block))
    parts = placed.withColumn("block_no", F.explode(blocks))
    begin = F.greatest("first", F.col("block_no") * block)
    return parts.join(slots(sources, block), ["sid", "block_no"], "left").withColumns({
        "begin": begin, "end": F.least(F.col("first") + F.col("size"), "until")})


def schedule(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
             weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 64) -> DataFrame:
    """The mixed sequence: slot, source, doc_id, key, pass_no, stream_at, begin, words.

    A slot's block is words many words of a document from its word begin on, counted from 0, for each
    document that the block reaches into, in the order of the source's stream, which stream_at gives.
    Slots in order are the mix: every stretch of them is close to the shares. pass_no is how often the
    source has been used up before. key is row_key; repeated rows have the same.
    """
    parts = _parts(docs, source_col, text_col, id_col, weights, share, most, block)
    return parts.where("slot is not null and end > begin").select(
        "slot", "source", "doc_id", "key", "pass_no", F.col("begin").alias("stream_at"),
        (F.col("begin") - F.col("first")).alias("begin"), (F.col("end") - F.col("begin")).alias("words"))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
        weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 64) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target and taken.

    size counts words, target is the source's, taken is how many words of the document the mix takes,
    repeats counted. A source's taken words are its target, rounded down; no document exceeds most
    times its size, rounded up to a whole number. Null is a source of its own, null texts have no
    words. Repeated rows and null ids are documents of their own. The order of documents comes from a
    hash of their rows, so reruns agree.
    """
    parts = _parts(docs, source_col, text_col, id_col, weights, share, most, block)
    return parts.groupBy("doc_id", "size", "source_size", "target", "sid", "bucket", "place").agg(
        F.sum(F.when(F.col("slot").isNull(), 0).otherwise(F.greatest(F.col("end") - F.col("begin"), F.lit(0))))
        .alias("taken")) \
        .select("doc_id", "size", "source_size", "target", "taken")
