"""Language identification with a linear-chain conditional random field over words.

Affixes, letter n-grams and the word itself, hashed, score each word for each language; learned
transitions tie neighbours together; forward-backward gives each word's language distribution, also
where a text switches. A document's language is the one with most letters. The model is fitted on a
bounded sample of labelled documents; prediction is one narrow pass.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import land

WORD = re.compile(r"[^\W\d_]{1,40}")      # longer runs of letters are several words
UNKNOWN = "und"
DOCS_PER_LANGUAGE = 500     # most labelled documents used of each language
SAMPLE_CHARS = 20_000       # of a longer document, a stretch of so many characters is used for fitting
CHAINS, CHAIN_WORDS = 3_000, 60
BITS = 16
CACHED_WORDS, CHUNK_WORDS = 400_000, 400_000
STRETCH_WORDS = 200         # of a document in one chain


def features(word: str) -> list[int]:
    """Hashed affixes, letter bigrams and trigrams, and lexicon entry of a lower-case word."""
    w = f"^{word}$"
    names = {w, *(w[i:i + 2] for i in range(len(w) - 1)), *(w[i:i + 3] for i in range(len(w) - 2)),
             "<" + w[:4], "<" + w[:5], ">" + w[-4:], ">" + w[-5:]}
    return [zlib.crc32(x.encode()) & (1 << BITS) - 1 for x in names]


def letters(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Model:
    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels, self.weights = labels, np.zeros((1 << BITS, n), np.float32)
        self.moves, self.begin = np.zeros((n, n)), np.zeros(n)

    def fit(self, texts: list[str], langs: list[str], steps: int = 40, seed: int = 7) -> Model:
        """Adam on the conditional likelihood of chains spliced from stretches of one to three texts."""
        rng = np.random.default_rng(seed)
        label = {x: i for i, x in enumerate(self.labels)}
        docs = [(letters(t), label[x]) for t, x in zip(texts, langs, strict=True)]
        docs = [d for d in docs if d[0]]
        by_label = [[d for d in docs if d[1] == i] for i in range(len(self.labels))]
        by_label = [x for x in by_label if x]
        if not by_label:
            return self
        rows, ids, gold, known = [], [], [], {}
        for _ in range(CHAINS):
            chain = []
            parts = rng.integers(1, 4)
            for _ in range(parts):
                group = by_label[rng.integers(len(by_label))]
                words, y = group[rng.integers(len(group))]
                size = min(len(words), CHAIN_WORDS // parts)
                at = rng.integers(len(words) - size + 1)
                chain += [(w, y) for w in words[at:at + size]]
            rows.append(len(chain))
            for w, y in chain:
                ids.append(known.setdefault(w, len(known)))
                gold.append(y)
        lists = [features(w) for w in known]
        sizes = np.array([len(x) for x in lists])
        flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)
        chains = Chains(np.array(rows), np.array(ids), len(self.labels))
        gold, n = np.array(gold), len(self.labels)
        seen = np.zeros((len(gold), n))
        seen[np.arange(len(gold)), gold] = 1
        follows = np.ones(len(gold), bool)
        follows[chains.offsets] = False
        pairs = np.zeros((n, n))
        np.add.at(pairs, (gold[np.flatnonzero(follows) - 1], gold[follows]), 1)
        theta = [np.zeros((1 << BITS, n)), self.moves, self.begin]
        first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
        for step in range(1, steps + 1):
            scores = np.stack([np.bincount(owner, theta[0][flat, k], len(lists)) for k in range(n)], 1)
            posterior, moved = chains.run(scores, theta[1], theta[2], want_moves=True)
            error = seen - posterior
            by_word = np.stack([np.bincount(chains.ids, error[:, k], len(lists)) for k in range(n)], 1)
            grads = [np.stack([np.bincount(flat, by_word[owner, k], 1 << BITS) for k in range(n)], 1),
                     pairs - moved, error[chains.offsets].sum(0)]
            for x, g, m, v in zip(theta, grads, first, second, strict=True):
                g = g / len(rows) - 1e-4 * x
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x += 0.1 * m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.weights = theta[0].astype(np.float32)
        return self


class Chains:
    """Word sequences laid end to end, longest first, and forward-backward over all at once."""

    def __init__(self, sizes: np.ndarray, ids: np.ndarray, labels: int):
        self.sizes, self.ids, self.labels = sizes, ids, labels
        self.offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.order = np.argsort(-sizes, kind="stable")

    def run(self, scores: np.ndarray, moves: np.ndarray, begin: np.ndarray, want_moves: bool = False):
        """Posterior of each word over labels, and expected transitions."""
        emit = np.exp(scores - scores.max(1, keepdims=True))[self.ids]
        step, starts, sizes = np.exp(moves), self.offsets[self.order], self.sizes[self.order]
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
        alpha = np.empty_like(emit)
        now = np.exp(begin) * emit[starts]
        for t, k in enumerate(active):
            at = starts[:k] + t
            if t:
                now = (now[:k] @ step) * emit[at]
            now /= now.sum(1, keepdims=True)
            alpha[at] = now
        beta, moved = np.ones((len(starts), self.labels)), np.zeros((self.labels, self.labels))
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            at = starts[:k] + t
            more = active[t + 1] if t + 1 < len(active) else 0
            if more:
                ahead = emit[at[:more] + 1] * beta[:more]
                if want_moves:
                    joint = alpha[at[:more], :, None] * step * ahead[:, None, :]
                    moved += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                back = ahead @ step.T
                beta[:more] = back / back.sum(1, keepdims=True)
            both = alpha[at] * beta[:k]
            alpha[at] = both / both.sum(1, keepdims=True)
        return alpha, moved


class Reader:
    """A model with the word scores a Python worker has met."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.scores = np.empty((CACHED_WORDS, len(model.labels)), np.float32)

    def predict(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """Language and its share of letters for each list of words.

        Documents are read in stretches of STRETCH_WORDS, each a chain, so that many chains advance
        together also where one document is long.
        """
        labels, out = self.model.labels, [(UNKNOWN, 0.0)] * len(texts)
        at = 0
        while at < len(texts) and labels:
            upto, part = at, []
            while upto < len(texts) and (not part or len(part) + len(texts[upto]) <= CHUNK_WORDS):
                part += texts[upto]
                upto += 1
            sizes, begin = np.array([len(x) for x in texts[at:upto]]), at
            at = upto
            if not part:
                continue
            some = np.flatnonzero(sizes)
            letters = np.fromiter(map(len, part), np.float64, len(part))
            shares = np.zeros((len(some), len(labels)))
            owner = np.repeat(np.arange(len(some)), sizes[some])
            for first in range(0, len(part), CHUNK_WORDS):      # one text can be longer than a chunk
                words, of = part[first:first + CHUNK_WORDS], owner[first:first + CHUNK_WORDS]
                ids, scores = self.ids(words)
                place = np.arange(len(words)) - np.searchsorted(of, of)
                starts = np.flatnonzero(place % STRETCH_WORDS == 0)
                chains = Chains(np.diff(np.append(starts, len(words))), ids, len(labels))
                posterior, _ = chains.run(scores, self.model.moves, self.model.begin)
                weighted = posterior * letters[first:first + CHUNK_WORDS, None]
                for k in range(len(labels)):
                    shares[:, k] += np.bincount(of, weighted[:, k], len(some))
            shares /= np.bincount(owner, letters, len(some))[:, None]
            best = shares.argmax(1)
            for i, k, p in zip(some.tolist(), best.tolist(), shares[np.arange(len(some)), best].tolist(), strict=True):
                out[begin + i] = labels[k], min(1.0, p)
        return out

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words in a table of word scores, and the table."""
        new = list(set(words) - self.index.keys())
        if len(self.index) + len(new) > CACHED_WORDS:
            self.index, new = {}, list(set(words))
        if new:
            lists = [features(w) for w in new]
            begin = np.cumsum([0] + [len(x) for x in lists[:-1]])
            first = len(self.index)
            for at in range(0, len(new), 20_000):
                some = np.concatenate(lists[at:at + 20_000])
                self.scores[first + at:first + min(at + 20_000, len(new))] = np.add.reduceat(
                    self.model.weights[some], begin[at:at + 20_000] - begin[at])
            self.index |= zip(new, range(first, first + len(new)))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)), self.scores[:len(self.index)]


def sample(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """At most DOCS_PER_LANGUAGE labelled texts of each language, those with the smallest hashes; of a
    text over SAMPLE_CHARS, a stretch that its hash chooses. The fit draws CHAINS chains from them, of
    CHAIN_WORDS words at most.

    A language's count sets the share of hashes that can matter, so that what is ordered stays small
    however many documents it has.
    """
    order = Window.partitionBy("lang").orderBy("hash", "text")
    docs = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    docs = docs.withColumn("hash", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    docs = docs.withColumn("text", F.substr("text", (F.col("hash") % spare + 1).cast("int"), F.lit(SAMPLE_CHARS)))
    share = F.least(F.lit(1.0), 8 * DOCS_PER_LANGUAGE / F.count("*"))
    shares = land(docs.groupBy("lang").agg((share * (1 << 40)).cast("long").alias("below")), "shares")
    some = docs.join(shares, "lang").where("hash <= below")
    return some.withColumn("n", F.row_number().over(order)).where(f"n <= {DOCS_PER_LANGUAGE}") \
        .select("text", "lang")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits a model on a sample of docs; without labelled texts it knows no language."""
    rows = sorted(map(tuple, sample(docs, text_col, lang_col).collect()), key=lambda r: (r[1], r[0]))
    model = Model(sorted({lang for _, lang in rows}))
    return model.fit([t for t, _ in rows], [lang for _, lang in rows])


_READERS: dict = {}


def predict(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """Adds a struct of lang_pred and score; a column named out_col is replaced.

    Texts that are null or have no letter, and all texts if the model knows no language, get 'und'
    and score 0. Runs of over 40 letters are read as several words.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)      # 2^16 features times the languages
    key = zlib.crc32(model.weights.tobytes())

    @F.arrow_udf("lang_pred string, score double")
    def language(texts: pa.Array) -> pa.Array:
        if key not in _READERS:
            _READERS.clear()
            _READERS[key] = Reader(shared.value)
        reader, out, part, size = _READERS[key], [], [], 0
        for text in texts:
            part.append(letters(text.as_py()))
            size += len(part[-1])
            if size >= 4 * CHUNK_WORDS:
                out += reader.predict(part)
                part, size = [], 0
        out += reader.predict(part)
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in out], pa.string()), pa.array([p for _, p in out], pa.float64())],
            ["lang_pred", "score"])

    return df.withColumn(out_col, language(F.col(text_col)))
