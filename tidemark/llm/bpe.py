"""Byte-pair encoding and decoding with prefix-sharing tries of distinct words.

The encoding of a prefix never changes when the word goes on, so the last token of each prefix
is a state of its trie node: token t ends a prefix p exactly if the state of p without t may
stand before t. Distinct words of a batch go into a trie, one depth-first walk fills in the
states, and prefixes that words share are encoded once. Documents are independent: there is no
shuffle, and a lost task is just run again.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# The split pattern and byte alphabet of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

OPEN_SPACE = re.compile(r" (?=\s|\Z)").search
CACHED_PIECES = 400_000    # encodings a Python worker remembers
CACHED_PAIRS = 2_000_000
CHUNK_CHARS = 6_000_000    # texts whose new words are encoded together
TOKEN = -1                 # key of a vocabulary node's token beside the bytes
NEVER = 1 << 40
_LOADED: dict = {}


def _alphabet() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Vocabulary of a byte-level BPE file and the encodings found so far."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        letters = _alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ids = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
        bytes_of = {i: b for b, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.table = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.tokens: dict = {}          # trie of the vocabulary: byte -> node, TOKEN -> id
        for token, i in ids.items():
            node = self.tokens
            for byte in token:
                node = node.setdefault(byte, {})
            node[TOKEN] = i
        self.ranks, self.parts = {}, {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b = ids[left], ids[right]
            self.ranks[a, b] = rank
            self.parts.setdefault(ids[left + right], (a, b, rank))
        self.edges: tuple[dict, dict] = ({}, {})
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN).findall
        # of several special tokens at a place the longest wins
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")")

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Symbols at one end of a token from its outer byte on, each with the rank that takes it up."""
        if (known := self.edges[side].get(token)) is None:
            known, until, at = [], NEVER, token
            while True:
                known.append((at, until))
                if at not in self.parts:
                    break
                *halves, until = self.parts[at]
                at = halves[side]
            known.reverse()
            self.edges[side][token] = known
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves just these two tokens."""
        a, b, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            across = self.ranks.get((x, y), NEVER)
            if across < x_until and across <= y_until and across < NEVER:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, as integers in native byte order.

        In sorted order the words are a depth-first walk of their trie; only the nodes on the path
        to the current word are held, the rest of it is shared with the word before.
        """
        fits, tokens, found = self.fits, self.tokens, {}
        # by depth: the last token, where it starts, and tokens under way as (start, node)
        ends, starts, nodes, before = [-1], [0], [[(0, tokens)]], b""
        for path, word in sorted((word.encode(), word) for word in words):
            shared, most = 0, min(len(path), len(before))
            while shared < most and path[shared] == before[shared]:
                shared += 1
            del ends[shared + 1:], starts[shared + 1:], nodes[shared + 1:]
            node = nodes[shared]
            for depth in range(shared + 1, len(path) + 1):
                byte, above, node = path[depth - 1], node, []
                for start, place in above:          # longest token first
                    if (place := place.get(byte)) is None:
                        continue
                    node.append((start, place))
                    if len(ends) == depth and (token := place.get(TOKEN)) is not None:
                        if start:
                            pair = ends[start] << 32 | token
                            if (fit := fits.get(pair)) is None:
                                fit = fits[pair] = self.may_follow(ends[start], token)
                            if not fit:
                                continue
                        ends.append(token)
                        starts.append(start)
                node.append((depth, tokens))
                nodes.append(node)
            before, at, ids = path, len(path), []
            while at:
                ids.append(ends[at])
                at = starts[at]
            found[word] = array("i", ids[::-1]).tobytes()
        if len(fits) > CACHED_PAIRS:
            fits.clear()
        return found

    def cut_up(self, text: str) -> list[str | int]:
        """Pieces of a text that are encoded apart, and ids of special tokens."""
        if not any(s in text for s in self.special):
            return self.at_spaces(text)
        out = []
        for i, part in enumerate(self.cut.split(text)):
            out += [self.special[part]] if i % 2 else self.at_spaces(part)
        return out

    @staticmethod
    def at_spaces(text: str) -> list[str]:
        """Cuts before each space: it begins a word, unless white space or the end follows one."""
        if OPEN_SPACE(text):
            return [text]
        head, *rest = text.split(" ")
        return [head, *map(" ".__add__, rest)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as integers in native byte order."""
        texts = [self.cut_up(t) for t in texts]
        needed = set().union(*texts)
        new = [p for p in needed if p not in self.pieces]
        if len(self.pieces) + len(new) > CACHED_PIECES:
            self.pieces = {p: self.pieces[p] for p in needed if p in self.pieces}
        split = {p: self.words_of(p) for p in new}
        known = self.encode_words({w for ws in split.values() for w in ws if isinstance(w, str)})
        known |= {i: array("i", [i]).tobytes() for i in new if isinstance(i, int)}
        for piece, ws in split.items():
            self.pieces[piece] = b"".join([known[w] for w in ws])
        return [b"".join(map(self.pieces.__getitem__, t)) for t in texts]

    def words_of(self, piece: str | int) -> list[str | int]:
        if isinstance(piece, int) or (piece.isascii() and piece[1:].isalpha() and piece[0] == " "):
            return [piece]
        return self.split(piece)

    def decode(self, ids: np.ndarray) -> str:
        known = ids[(ids >= 0) & (ids < len(self.table))]
        return b"".join(map(self.table.__getitem__, known.tolist())).decode("utf-8", "replace")


def _chunks(texts):
    """Texts of an Arrow array, null as empty, in lists of bounded length or one long text."""
    chunk, size = [], 0
    for text in texts:
        chunk.append(text.as_py() or "")
        size += len(chunk[-1])
        if size >= CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _loaded(key: str, spec) -> Encoder:
    """One encoder for each Python worker and tokenizer file."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(spec.value)
    return _LOADED[key]


def _shared(df: DataFrame, tokenizer: str):
    """The tokenizer file, a few MB whatever the input, read once on the driver, and its digest."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    key = hashlib.sha256(spec.encode()).hexdigest()
    return key, df.sparkSession.sparkContext.broadcast(spec)


def _encoded(encoder: Encoder, texts: pa.Array) -> list[bytes]:
    return [ids for chunk in _chunks(texts) for ids in encoder.encode(chunk)]


def _lists(out: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, out)]) // 4
    values = pa.array(np.frombuffer(b"".join(out), np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text; a column named out_col is replaced.

    Special tokens in a text are recognised, none is added. A null or empty text gives an empty
    list. Rows are kept as they are, repeated ones too.
    """
    shared = _shared(df, tokenizer)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _lists(_encoded(_loaded(*shared), texts))

    return df.withColumn(out_col, ids(F.col(text_col)))


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text that token ids stand for; a column named out_col is replaced.

    Null ids and ids outside the vocabulary stand for nothing, a null list for an empty text;
    bytes that are not UTF-8 become replacement characters.
    """
    shared = _shared(df, tokenizer)

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        encoder, none = _loaded(*shared), np.array([], np.int32)
        return pa.array([encoder.decode(x.values.drop_null().to_numpy() if x.is_valid else none)
                         for x in lists], pa.string())

    return df.withColumn(out_col, texts(F.col(ids_col)))


def round_trip(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids",
               decoded_col: str = "decoded") -> DataFrame:
    """Adds the ids of each text and what they decode to, as encode and decode do.

    One function call makes both: Spark would run encode twice if two functions used its result.
    """
    shared = _shared(df, tokenizer)

    @F.arrow_udf("ids array<int>, decoded string")
    def both(texts: pa.Array) -> pa.Array:
        encoder = _loaded(*shared)
        out = _encoded(encoder, texts)
        decoded = pa.array([encoder.decode(np.frombuffer(x, np.int32)) for x in out], pa.string())
        return pa.StructArray.from_arrays([_lists(out), decoded], ["ids", "decoded"])

    both = both(F.col(text_col))
    return df.withColumns({ids_col: both["ids"], decoded_col: both["decoded"]})
