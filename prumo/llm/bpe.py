"""Exact encoding with a byte-level BPE vocabulary by dynamic programming over prefixes.

Every prefix of a piece has exactly one last token in its encoding. An automaton over the vocabulary lists, through its
suffix links, all tokens that end at a position; a token is the last one of the prefix exactly if it starts the piece or
the pair (last token of the prefix before it, the token) is compatible, that is, if merging would leave this pair as it
is. Following the back-pointers from the end gives the ids. The time is linear in the text for any piece, however long.

Defined results: null and empty texts give an empty list of ids; special tokens are never produced, their strings are
ordinary text; texts of any length are encoded whole; repeated keys give a row each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The pattern of the public byte-level vocabularies of this kind (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary files lie, unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """Tokens by id, from a rank file; ids must be 0 to n - 1. A vocabulary is of fixed size: it may be broadcast."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            token, _, rank = line.strip().partition(b" ")
            if token:
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


class Vocabulary:
    """Tokens, the pair each was merged from, and the pair that merges into each."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        #: For a single byte, the token itself twice.
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        self._known: dict[int, bool] = {}
        for i, t in enumerate(tokens):  # in order of rank: the halves of a token come before it
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None and a < i and b < i and self.compatible(a, b, i):
                    self.left[i], self.right[i] = a, b
                    self.merged[a, b] = i
                    break
        self._known.clear()

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether a and b, side by side, are what merging their bytes with all merges of rank under below leaves.

        Undo the later of the two tokens' last merges, again and again, down to the bytes at the boundary; the pair
        breaks if, at any time, two neighbours across the boundary could have merged earlier than what is left to undo.
        """
        top = len(self.tokens) if below is None else below
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < top:
                return False
            if a > b:  # a's last merge came later: its right half stood at the boundary before
                top, half = a, self.right[a]
                if half == a:  # a single byte; go on with b, for what is at or above its rank
                    top, half = b + 1, self.left[b]
                    if half == b:
                        return True
                    b = half
                else:
                    a = half
            else:
                top, half = b + 1, self.left[b]
                if half == b:
                    top, half = a, self.right[a]
                    if half == a:
                        return True
                    a = half
                else:
                    b = half

    def fits(self, a: int, b: int) -> bool:
        """compatible() with memory."""
        key = a << 32 | b
        known = self._known.get(key)
        if known is None:
            if len(self._known) > 2_000_000:
                self._known.clear()
            known = self._known[key] = self.compatible(a, b)
        return known


class Encoder:
    """Encodes texts; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.v = vocabulary
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(vocabulary.tokens):
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.known: dict[str, list[int]] = {}

    def piece(self, s: str) -> list[int]:
        """The ids of one piece of the pattern."""
        data = s.encode("utf-8")
        n = len(data)
        last = [-1] * (n + 1)
        fits, tokens = self.v.fits, self.v.tokens
        for end, (t, size) in self.automaton.iter(data.decode("latin-1")):
            if last[end + 1] < 0:
                start = end + 1 - size
                if start == 0 or last[start] >= 0 and fits(last[start], t):
                    last[end + 1] = t
        out = []
        while n:
            t = last[n]
            out.append(t)
            n -= len(tokens[t])
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        out: list[int] = []
        known = self.known
        for s in self.find(text):
            ids = known.get(s)
            if ids is None:
                ids = self.piece(s)
                if len(s) < 64:
                    if len(known) > 500_000:
                        known.clear()
                    known[s] = ids
            out += ids
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(stamp: str, shared) -> Encoder:
    """The worker's encoder of a vocabulary, made once."""
    if stamp not in _encoders:
        _encoders[stamp] = Encoder(Vocabulary(shared.value))
    return _encoders[stamp]


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly where the input has fewer splits than the cluster has cores; else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(2 * cores) if splits < cores else df


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """Rows (key, ids) of every row, or (key, tokens) with the number of ids only."""
    tokens = read_ranks(vocabulary)
    stamp = hashlib.sha256(b"\0".join(tokens)).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    flat = spread(df.select(key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(stamp, shared).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids = [encode(t) if t else [] for t in b.column(1).to_pylist()]
                second = pa.array([len(x) for x in ids], pa.int32()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), second], names=[key, "tokens" if counts_only else "ids"])

    return flat.mapInArrow(run, f"`{key}` {flat.schema[0].dataType.simpleString()}, " + ("tokens int" if counts_only else "ids array<int>"))
