"""Problem 6: encoding a corpus with a public byte-level BPE vocabulary.

Every text is cut into pre-tokens by the vocabulary's pattern; within a
pre-token the merges are found with a segment tree over the ranks of adjacent
pairs: its root names the leftmost pair of lowest rank, a merge changes three
leaves, and each change climbs one path to the root. A pre-token of n bytes thus
takes O(n log n), also where it is a megabyte without a space.

Rows never meet: the operator is one ``mapInArrow`` without a shuffle, so it
scales with the number of input splits and no group can become hot. A pre-token that
is itself a token needs no merge. Words repeat far more than they are new, so each
Python worker keeps the ids that the tree gave for the words it has met (bounded by
``CACHE_WORDS``, short words only).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Words whose ids a worker keeps, and the longest word (in characters) kept.
CACHE_WORDS, CACHE_CHARS = 400_000, 48
#: No pair: larger than every rank.
NONE = 1 << 60


def default_vocabulary() -> str:
    """The place of byte_bpe_50k in the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Rank file lines ``base64 rank`` as a dictionary."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class PairTree:
    """Segment tree over the ranks of adjacent pairs; the root holds the least."""

    __slots__ = ("size", "least")

    def __init__(self, ranks: list[int]):
        size = self.size = 1 << max(0, len(ranks) - 1).bit_length()
        level = ranks + [NONE] * (size - len(ranks))
        levels = [level]
        while len(level) > 1:
            level = list(map(min, level[::2], level[1::2]))
            levels.append(level)
        self.least = [NONE]
        for level in reversed(levels):  # node i has the children 2 i and 2 i + 1
            self.least += level

    def set(self, at: int, rank: int) -> None:
        least = self.least
        i = at + self.size
        while i and least[i] != rank:
            least[i] = rank
            other = least[i ^ 1]
            if other < rank:
                rank = other
            i >>= 1

    def leftmost_least(self) -> tuple[int, int]:
        """(position, rank) of the leftmost pair of lowest rank; rank NONE: no pair."""
        least = self.least
        rank = least[1]
        if rank == NONE:
            return -1, NONE
        i, size = 1, self.size
        while i < size:
            i += i
            if least[i] != rank:
                i += 1
        return i - size, rank


class BytePairEncoder:
    """Ids of texts; special tokens' strings are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_words: int = CACHE_WORDS):
        import regex

        self.ranks, self.find, self.cache_words = ranks, regex.compile(pattern).findall, cache_words
        self.cache: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        get, n = ranks.get, len(parts)
        tree = PairTree([get(data[i : i + 2], NONE) for i in range(n - 1)])
        change = tree.set
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while True:
            i, rank = tree.leftmost_least()
            if rank == NONE:
                break
            j = after[i]
            left = parts[i] = parts[i] + parts[j]
            parts[j] = b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                change(j, NONE)
                change(i, get(left + parts[k], NONE))
            else:
                change(i, NONE)
            h = before[i]
            if h >= 0:
                change(h, get(parts[h] + left, NONE))
        return [ranks[p] for p in parts if p]

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text; null and empty texts have none."""
        if not text:
            return []
        out: list[int] = []
        cache, extend = self.cache, out.extend
        for word in self.find(text):
            ids = cache.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8", "replace"))
                if len(word) <= CACHE_CHARS:
                    if len(cache) >= self.cache_words:
                        cache.clear()
                    cache[word] = ids
            extend(ids)
        return out


#: Encoders of this Python worker, by (length of the vocabulary, its pattern).
_ENCODERS: dict[tuple[int, str], BytePairEncoder] = {}


def encoder_of(data: bytes, pattern: str) -> BytePairEncoder:
    key = (hash(data), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = BytePairEncoder(load_ranks(data), pattern)
    return _ENCODERS[key]


def vocabulary_bytes(path: str) -> bytes:
    """A rank file; its size is checked, for it is broadcast."""
    if os.path.getsize(path) > 32 << 20:
        raise ValueError("a vocabulary of more than 32 MB is not broadcast")
    with open(path, "rb") as f:
        return f.read()


def encode_corpus(
    spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row of ``df``.

    Null and empty texts have an empty list; blank texts have the ids of their
    blanks. Repeated rows come out as often as they come in, a null key stays
    null, an empty table gives an empty one, other columns are not read. Texts of
    any length are encoded whole. Special tokens' strings are ordinary text.
    """
    import pyarrow as pa

    data = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary or default_vocabulary()))
    split = pattern or default_pattern()
    rows = df.select(df[key].alias("k"), df[text].cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(data.value, split).encode
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for at in range(0, len(texts), 500):
                ids = [encode(t) for t in texts.slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([keys.slice(at, 500), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
