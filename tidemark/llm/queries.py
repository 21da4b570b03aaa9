"""Registered queries: each operator over its whole table, reduced to the columns asked for."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import (
    bpe, divergence, fingerprints, hamming, langid, line_rules, lines, merkle, mixing, quality, quotes, simhash,
    suffixes,
)
from tidemark.session import land

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_digests(docs: DataFrame) -> DataFrame:
    return bpe.round_trip(docs.select("doc_id", "text"), TOKENIZER).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op1_bpe(spark, sf_dir):
    """Encodes every document and decodes the ids again."""
    return bpe_digests(table(spark, sf_dir, "documents"))


def edit_likeness(docs: DataFrame) -> DataFrame:
    return fingerprints.against_edits(docs).select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next",
    )


@query
def op3_fingerprints(spark, sf_dir):
    """Fingerprints of documents, of their edited texts, and how alike they are."""
    return edit_likeness(table(spark, sf_dir, "documents"))


@query
def op10_mixing(spark, sf_dir):
    """Words that the mix of sources takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def line_digests(docs: DataFrame) -> DataFrame:
    n_lines = F.size(F.split("text", "\n")).alias("n_lines")
    docs = docs.select("doc_id", "text", F.when(F.col("text").isNotNull(), n_lines).alias("n_lines"))
    return lines.dedup_lines(docs).select(
        "doc_id", "n_lines", F.col("removed_lines").alias("n_removed"),
        F.sha2(F.col("text"), 256).alias("text_sha256"))


@query
def op9_line_dedup(spark, sf_dir):
    """Documents without the later copies of runs of lines with 50 words or more."""
    return line_digests(table(spark, sf_dir, "documents"))


SQL["op9_line_dedup"] = r"""
with docs as (select doc_id, text, string_split(text, chr(10)) lines from documents),
numbered as (
  select doc_id, generate_subscripts(lines, 1) - 1 line_no, unnest(lines) line from docs
), counted as (
  select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) words from numbered
), placed as (
  select *, sum(words) over (partition by doc_id order by line_no)::bigint stop
  from counted where words > 0
), starts as (select *, stop - words start from placed),
windows as (
  select doc_id, line_no first, max(line_no) over a last, string_agg(line, chr(10)) over a content,
         sum(words) over a n from starts
  window a as (partition by doc_id order by start range between current row and 49 following)
  union all
  select doc_id, min(line_no) over b, line_no, string_agg(line, chr(10)) over b, sum(words) over b
  from starts
  window b as (partition by doc_id order by stop range between 49 preceding and current row)
), later as (
  select doc_id, first, last from (
    select *, min((doc_id, first)) over (partition by content) earliest from windows where n >= 50
  ) where (doc_id, first) > earliest
), gone as (
  select distinct doc_id, unnest(generate_series(first, last)) line_no from later
), kept as (
  select doc_id, count(*) - count(gone.line_no) n_kept, count(gone.line_no) n_removed,
         coalesce(string_agg(line, chr(10) order by line_no) filter (gone.line_no is null), '') text
  from numbered left join gone using (doc_id, line_no) group by doc_id
)
select doc_id, len(lines)::int n_lines, coalesce(n_removed, 0)::int n_removed, sha256(kept.text) text_sha256
from docs left join kept using (doc_id)
"""


def simhash_groups(docs: DataFrame) -> DataFrame:
    return simhash.groups(simhash.fingerprints(docs.select("doc_id", "text"))).select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_simhash(spark, sf_dir):
    """SimHash of each document's 3-word shingles, and the group that links at 2 bits make."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def languages(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "language.*")


@query
def op6_language_id(spark, sf_dir):
    """Language of each document; documents whose checksum leaves 2 are not learned from."""
    return languages(table(spark, sf_dir, "documents"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    feats = quality.measured(docs.select("doc_id", "text", "source", "lang")).drop("row")
    feats = land(feats, "measures")
    return quality.classify(feats, quality.fit(feats, labels)).select(
        "doc_id", "evidence", "host_quality", "path_quality", "quality", "keep")


@query
def op5_quality(spark, sf_dir):
    """Quality posterior of each document from its text, its source and its language section."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def as_replies(turns: DataFrame) -> DataFrame:
    """Conversations as they look in mail: turns quote the turns before them, in three ways.

    The table has no quotes, so they are derived here, by the number of the turn: '>' for the whole
    turn before and '>>' for the one before that; only its last line; or its first line, the reply, its
    last line and the reply again. A conversation's first turn quotes nothing.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")

    def quote(text, n):
        return F.regexp_replace(text, "(?m)^", ">" * n + " ")

    last, own = F.lag("text").over(order), F.col("text")
    first_line, last_line = F.substring_index(last, "\n", 1), F.substring_index(last, "\n", -1)
    way = F.pmod(F.col("turn"), F.lit(3))
    parts = F.when(way == 1, F.array(quote(F.lag("text", 2).over(order), 2), quote(last, 1), own)).when(
        way == 2, F.array(quote(last_line, 1), own)).otherwise(
        F.array(quote(first_line, 1), own, quote(F.when(last.isNotNull(), last_line), 1), F.when(last.isNotNull(), own)))
    return turns.select("conv_id", "turn", "role", F.when(own.isNotNull(), F.array_join(
        F.filter(parts, lambda x: x.isNotNull()), "\n")).alias("text"))


@query
def op8_quotation_linking(spark, sf_dir):
    """Messages in reply order, linked by what they quote and freed of it."""
    return quotes.link(as_replies(table(spark, sf_dir, "conversations"))).select(
        "conv_id", "turn", "role", "parent", "root", "depth", F.sha2(F.col("text"), 256).alias("text_sha256"))


@query
def op7_hamming_search(spark, sf_dir):
    """Ten nearest codes of every vector whose id is divisible by 20, among all vectors."""
    rows = hamming.codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = land(rows.drop("embedding"), "vector-codes")
    return hamming.top_k(rows, rows.where("vec_id % 20 = 0"))


def substring_digests(docs: DataFrame, length: int = suffixes.LENGTH) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return suffixes.dedup_substrings(docs, length).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"), F.col("kept").cast("string").alias("kept_text"))


@query
def op4_suffix_dedup(spark, sf_dir):
    """Documents without the bytes that strings of 400 bytes found elsewhere cover."""
    return substring_digests(table(spark, sf_dir, "documents"))


@query
def op11_line_rules(spark, sf_dir):
    """Rules on each document, and those that lose too much with lines frequent on their source."""
    return line_rules.judge(table(spark, sf_dir, "documents"))


SQL["op11_line_rules"] = r"""
with docs as (
  select row_number() over () rid, doc_id, coalesce(source, '') || (source is null) host, coalesce(text, '') text
  from documents
), measured as (
  select rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') words,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) filled from docs
), placed as (
  select rid, generate_subscripts(words, 1) i, unnest(words) w from measured
), windows as (
  select rid, i, [w, lead(w, 1) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o] run,
         lead(i, 4) over o is not null whole from placed window o as (partition by rid order by i)
), runs as (
  select rid, i, count(*) over (partition by rid, run) times from windows where whole
), covered as (
  select rid, count(distinct i + k) n from runs, range(5) t(k) where times > 1 group by rid
), texts as (select distinct host, text from docs),
lines as (
  select host, text, unnest(string_split(regexp_replace(lower(text), '[0-9]+', '0', 'g'), chr(10))) line from texts
), held as (
  select host, text, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') line,
         sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) words from lines group by all having words > 0
), often as (
  select host, line from held group by host, line having count(*) > 10
), frequent as (
  select host, line, count(*) n from held semi join often using (host, line) group by host, line
), above as (
  select host, line from frequent join (select host, count(*) docs from texts group by host) using (host)
  where n > 0.02 * docs
), lost as (select host, text, sum(words) lost from held semi join above using (host, line) group by host, text),
judged as (
  select doc_id, len(words) n_words, len(array_to_string(words, '')) word_chars, n_symbols,
         len(filled) - len(list_distinct(filled)) n_dup_lines, coalesce(n, 0) n_repeat_words,
         n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed, coalesce(lost, 0) gone
  from measured left join covered using (rid) left join lost using (host, text)
)
select * exclude (gone), not base_failed and not (gone > 0.5 * n_words or (gone > 0 and n_words - gone < 10)) kept
from judged
"""


def manifest_checks(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of documents by language, and what a tampered third folds to."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    whole, tampered = merkle.leaf([*columns, F.col("text")]), merkle.leaf([*columns, lowered])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = merkle.manifest(docs.select(
        F.col("lang").alias("grp"), F.col("doc_id").alias("id"), whole.alias("leaf"),
        F.when(hit, tampered).alias("seen")))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    folded = merkle.fold(F.coalesce("seen", "leaf"), F.col("proof"))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_merkle(spark, sf_dir):
    """Merkle manifest of all documents by language, checked against a tampered third of them."""
    return manifest_checks(table(spark, sf_dir, "documents"))


# crc32 is folded over the decimal digits; a level of the trees is a step of the recursion
SQL["op12_merkle"] = r"""
with recursive leaves as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 place,
         count(*) over (partition by lang) n from (
    select row_number() over () rid, doc_id, coalesce('=' || lang, '') lang,
           sha256(concat_ws('', head, coalesce(strlen(text) || ':' || text, '-'))) leaf,
           xor(list_reduce(list_prepend(4294967295, list_transform(
             string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: list_reduce(
             list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 3 = 0 hit,
           sha256(concat_ws('', head, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '-'))) tampered
    from (select *, concat_ws('', coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'),
            coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
            coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) head from documents))
), up as (
  select lang, 0 lv, place i, n, leaf h from leaves
  union all
  select lang, lv + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' order by i))
  from up where n > 1 group by lang, lv, i // 8
), subroots as (
  select lang, h subroot, row_number() over (order by lang) - 1 place, count(*) over () n from up where n = 1
), top as (
  select 100 lv, place i, n, subroot h from subroots
  union all
  select lv + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' order by i)) from top where n > 1 group by lv, i // 8
), steps as (
  select rid, lv, coalesce(string_agg(h, '' order by i) filter (i < place // (8 ** lv)::bigint), '') lo,
         coalesce(string_agg(h, '' order by i) filter (i > place // (8 ** lv)::bigint), '') hi
  from leaves join up using (lang) where up.n > 1 and up.i // 8 = place // (8 ** (lv + 1))::bigint group by rid, lv
  union all
  select rid, lv, coalesce(string_agg(h, '' order by i) filter (i < s.place // (8 ** (lv - 100))::bigint), ''),
         coalesce(string_agg(h, '' order by i) filter (i > s.place // (8 ** (lv - 100))::bigint), '')
  from leaves join subroots s using (lang), top where top.n > 1 and top.i // 8 = s.place // (8 ** (lv - 99))::bigint group by rid, lv
), numbered as (select *, row_number() over (partition by rid order by lv) step from steps),
folded as (
  select rid, 0 step, if(hit, tampered, leaf) h from leaves
  union all
  select rid, numbered.step, sha256(lo || h || hi) from folded join numbered using (rid)
  where numbered.step = folded.step + 1
)
select doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) proof_sha256, folded_root, folded_root = root verified
from leaves join (select h root from top where n = 1) on true join subroots using (lang)
left join (select rid, string_agg(lo || hi, '' order by step) proof from numbered group by rid) using (rid)
join (select rid, arg_max(h, step) folded_root from folded group by rid) using (rid)
"""


@query
def op13_divergence(spark, sf_dir):
    """Divergence of each source's words from other sources and from its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op13_divergence"] = r"""
with docs as (
  select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') text
  from documents
), terms as (
  select rid, lang, source, unnest(regexp_extract_all(translate(
    text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from docs
), kept as (
  select lang, term, count(*) n from terms group by lang, term having count(distinct rid) >= 3
), langs as (select lang, sum(n)::bigint total, count(*) v from kept group by lang),
counts as (select lang, source, term, count(*) n from terms semi join kept using (lang, term) group by all),
sums as (select lang, source, sum(n)::bigint total from counts group by all),
groups as (
  select lang, source, coalesce(sums.total, 0) total, v
  from (select distinct lang, source from docs) left join sums using (lang, source) left join langs using (lang)
), given as (
  select lang, g.source, term, coalesce(c.n, 0) n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + v) p,
         1 + 1000000000 * (k.n + 1) // (l.total + v) q
  from groups g join kept k using (lang) join (select lang, total from langs) l using (lang)
  left join counts c using (lang, source, term)
), pairs as (
  select lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
  from given a join given b using (lang, term) where a.source <> b.source group by all
  union all
  select a.lang, a.source, b.source, 0 from groups a join groups b using (lang) where a.v is null and a.source <> b.source
), found as (
  select lang, source, 'pair' part, item, value from pairs
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // q from given where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int rank from found
)
select * from ranked where part = 'pair' or rank <= 200
"""
