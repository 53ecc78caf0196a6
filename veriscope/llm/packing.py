"""Best-fit packing of token pieces by exact-complement hashing.

Pieces differ only in their length for packing, and there are no more lengths than a
sequence has places.  So a table of counts per length, whatever the size of the corpus, is
packed on the driver: for the longest piece left, its gap is filled exactly by one, two or
three lengths found through their sums, as often as their counts allow; where no such
combination exists, the longest fitting length goes in and the search goes on.  The
resulting plan is a short table of ranges; every piece finds its place in it by its length
and its number among the pieces of that length.

Cases: a null or empty text is one piece of the closing id alone; a longer text than a
sequence is cut into full pieces, of which the first may be shorter; repeated rows are
packed as often as they occur, and equal lengths are ordered by a hash and the columns of the
piece; an empty table gives no sequences; further columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.ranks import HASH_RANGE, running_totals
from veriscope.llm.texts import has_columns
from veriscope.llm.token_counts import CHUNK, PIECE, REMEMBERED_CHARS, UNEVEN, Remembered, byte_characters, default_vocabulary
from veriscope.shared import settle

CAPACITY = 2048
CLOSING_ID = 0
REMEMBERED = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class TokenIds:
    """Little-endian unsigned 32-bit ids of a text, as ``tokenizers`` gives them for a byte-level
    vocabulary; pieces between blanks are remembered.

    Short pieces are merged by ``tiktoken`` over the ranks of the same vocabulary, which costs
    a quarter; long ones and texts with special strings by ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are parallel already
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = sorted(added)
        octets = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(octets[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in added}
        self.merging = tiktoken.Encoding("pieces", pat_str=PIECE.pattern, mergeable_ranks=ranks, special_tokens={})
        self.chunks = Remembered(self.encode, REMEMBERED)
        self.after_blank = Remembered(lambda rest: self.encode(" " + rest), REMEMBERED)

    def encode(self, chunk: str) -> bytes:
        if len(chunk) <= REMEMBERED_CHARS:
            return array("I", self.merging.encode_ordinary(chunk)).tobytes()
        return self.encode_long(chunk)

    def encode_long(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.encode_long(text)
        if UNEVEN.search(text):
            return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))
        first, *rest = text.split(" ")
        return self.chunks[first] + b"".join(map(self.after_blank.__getitem__, rest))


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of each piece; only the first may be shorter than ``capacity``."""
    first = tokens % capacity or min(tokens, capacity)
    edges = [0, *range(first, tokens + 1, capacity)]
    return list(zip(edges, edges[1:]))


def token_pieces(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None,
                 with_ids: bool = False) -> DataFrame:
    """The pieces of every document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``
    and, if asked for, ``ids``."""
    has_columns(df, "doc_id", "text")
    path = vocabulary or default_vocabulary()
    closing = np.array([CLOSING_ID], dtype="<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids

    def cut(batches):
        encode = token_ids(path)
        for batch in batches:
            found = [[] for _ in fields]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + closing
                for piece, (start, end) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = memoryview(ids)[4 * start:4 * end]
                    row = [doc_id, piece, start, end - start, zlib.crc32(own)]
                    for column, value in zip(found, row + [np.frombuffer(own, dtype="<u4")] * with_ids):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(found, fields)],
                                             names=[n for n, _ in fields])

    texts = df.select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


class Complements:
    """Which lengths are left, and an index of the sums of two."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        here = (self.left > 0).astype(np.int64)
        self.sums = np.convolve(here, here)[:capacity + 1]  # ordered pairs of lengths by their sum

    def take(self, pattern: list[int], times: int) -> None:
        for length, n in Counter(pattern).items():
            self.left[length] -= n * times
            if not self.left[length]:
                others = np.flatnonzero(self.left[:len(self.left) - length])
                self.sums[others + length] -= 2
                if 2 * length < len(self.sums):
                    self.sums[2 * length] -= 1

    def pair(self, total: int, spare: np.ndarray) -> list[int] | None:
        """Two lengths left in ``spare`` that make ``total``, the most unequal ones."""
        if total < 2 or not self.sums[total]:
            return None
        half = total // 2
        fits = (spare[1:half + 1] > 0) & (spare[total - half:total][::-1] > 0)
        if 2 * half == total and spare[half] < 2:
            fits[half - 1] = False
        small = int(np.argmax(fits)) + 1
        return [total - small, small] if fits[small - 1] else None

    def exact(self, gap: int, spare: np.ndarray) -> list[int] | None:
        """One, two or three lengths that fill ``gap``."""
        if spare[gap] > 0:
            return [gap]
        if two := self.pair(gap, spare):
            return two
        third = np.arange(gap - 2, 0, -1)
        for length in third[(spare[third] > 0) & (self.sums[gap - third] > 0)]:
            spare[length] -= 1
            two = self.pair(gap - int(length), spare)
            spare[length] += 1
            if two:
                return [int(length), *two]
        return None


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences each makes.

    Every pattern uses up one of its lengths (but for less than one more pattern), so that
    there are a few patterns per length, however many pieces there are.
    """
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"a piece has between 1 and {capacity} tokens")
    stock, plan = Complements(counts, capacity), []
    for longest in range(capacity, 0, -1):
        while stock.left[longest] > 0:
            pattern, gap, spare = [longest], capacity - longest, stock.left.copy()
            spare[longest] -= 1
            while gap:
                if more := stock.exact(gap, spare):
                    pattern += more
                    break
                fitting = np.flatnonzero(spare[:gap + 1] > 0)
                if not len(fitting):
                    break
                best = int(fitting[-1])
                pattern.append(best)
                spare[best] -= 1
                gap -= best
            times = min(int(stock.left[length]) // n for length, n in Counter(pattern).items())
            plan.append((pattern, times))
            stock.take(pattern, times)
    return plan


def plan_ranges(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, offset), ordered: where the pieces of a
    length go, by their number."""
    rows, used, sequence = [], Counter(), 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def packed(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to settled pieces with a ``length``."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    ranges = plan_ranges(packing_plan(counts, capacity))
    place = F.pmod(F.xxhash64(*order), F.lit(HASH_RANGE))
    numbered = running_totals(pieces, "length", place, F.lit(1).cast("long"), list(order), sum(counts.values()), "_number")
    span = 1 << 44
    keys = ranges[:, 0] * span + ranges[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        row = np.searchsorted(keys, length.to_numpy() * span + number.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": ranges[row, 2] + number.to_numpy() - ranges[row, 1], "offset": ranges[row, 3]})

    return numbered.withColumn("_at", placed("length", "_number")).select(*pieces.columns, "_at.*")


def packed_sequences(packed_pieces: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces with ``ids``: at most ``capacity`` ids each."""
    pieces = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(pieces.alias("_pieces")).select(
        "sequence_id", F.flatten("_pieces.ids").alias("ids"))


def pack_documents(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    return packed(settle(token_pieces(df, capacity, vocabulary), compact=True), capacity)


def op9_packing(spark, sf_dir):
    """All documents packed into sequences."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
