"""Token counts by byte-pair merging on a heap and a linked list.

A text is cut into pieces as the vocabulary's pre-tokenizer does.  The bytes of a piece form
a linked list; a heap holds the ranks of adjacent pairs.  The lowest rank is popped and
merged again and again; the count is the number of bytes minus the merges.  No identifiers
are emitted.

Cases: a null or empty text has no tokens; a text of one very long piece takes time in
proportion to n log n; texts that repeat are counted alike; special strings inside a text
count as one token each, as the vocabulary's library has it by default; further columns stay
as they are, those named like a count are replaced by it; an empty table stays empty.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.llm.texts import has_columns

TOKEN_LIMIT = 1024
# Pieces remembered by a Python worker, and the longest one that is.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64
# White space, and the pre-tokenizer's pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
# A blank beside white space: such a text cannot be cut at its blanks alone.
UNEVEN = regex.compile(rf" [{SPACE}]|[{SPACE}] ")
# White space with what follows it: pieces never reach across.
CHUNK = regex.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Remembered(dict):
    """Results of ``compute`` by key; forgets all when full, so that memory is bounded."""

    def __init__(self, compute, entries: int = REMEMBERED, chars: int = REMEMBERED_CHARS):
        super().__init__()
        self.compute, self.entries, self.chars = compute, entries, chars

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.chars:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else the next after 255."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class PairMerging:
    """Counts tokens of a byte-level vocabulary given as ``tokenizers`` JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = spec["model"]["vocab"]
        self.symbols = [names[c] for c in byte_characters()]
        self.ranks, self.merged = {}, []
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            self.ranks.setdefault((names[left], names[right]), rank)
            self.merged.append(names[left + right])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in special)) if special else None
        self.pieces = Remembered(self.merge)
        self.chunks = Remembered(self.count_pieces)
        self.after_blank = Remembered(lambda rest: self.count_pieces(" " + rest))

    def merge(self, piece: str) -> int:
        """Initial symbols minus merges."""
        symbols = [self.symbols[b] for b in piece.encode("utf-8")]
        end, ranks, merged = len(symbols), self.ranks, self.merged
        heap = [(rank, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
        heapify(heap)
        after, before, merges = list(range(1, end + 1)), list(range(-1, end - 1)), 0
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= end or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = merged[rank], -1
            after[i] = k = after[j]
            merges += 1
            if k < end:
                before[k] = i
                if (found := ranks.get((symbols[i], symbols[k]))) is not None:
                    heappush(heap, (found, i))
            if (h := before[i]) >= 0 and (found := ranks.get((symbols[h], symbols[i]))) is not None:
                heappush(heap, (found, h))
        return end - merges

    def count_pieces(self, chunk: str) -> int:
        return sum(map(self.pieces.__getitem__, PIECE.findall(chunk)))

    def count_plain(self, text: str) -> int:
        if UNEVEN.search(text):
            return sum(map(self.chunks.__getitem__, CHUNK.findall(text)))
        first, *rest = text.split(" ")
        return self.chunks[first] + sum(map(self.after_blank.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.count_plain(text)
        parts = self.special.split(text)
        return sum(map(self.count_plain, parts)) + len(parts) - 1


@lru_cache(maxsize=2)
def counter(path: str) -> PairMerging:
    """One per Python worker."""
    return PairMerging(path)


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of a text; the vocabulary's file must be at the same path on every executor."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("long")
    def counts(texts: pd.Series) -> pd.Series:
        return texts.map(counter(path).count).astype("int64")

    return counts(F.coalesce(text, F.lit("")))


def with_token_counts(df: DataFrame, text: str = "text", vocabulary: str | None = None,
                      limit: int = TOKEN_LIMIT) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    has_columns(df, text)
    counted = df.withColumns({
        "n_bytes": F.octet_length(F.coalesce(df[text], F.lit(""))).cast("long"),
        "n_tokens": token_count(df[text], vocabulary),
    })
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark, sf_dir):
    """Every document with its tokens."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_token_counts(documents).select("doc_id", "n_bytes", "n_tokens", "over_limit")
