"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put in another order.

A text is cut into chunks where a rolling hash of its bytes says so: passages that documents
share fall into the same chunks.  What is known of a chunk (its code points, the bytes at its
ends, whether a mark lies in it) is found once by a task and looked up for every further
chunk of the same content; the cache compares contents, not hashes.  Running sums of the
chunks' counts say in which chunk a cut lies, and only that one is walked through.  A mark
that lies across chunks shows in the bytes at their ends.

Cases: a null text is an empty one; empty texts and texts with a mark inside stay plain; a
null doc_id is drawn for like the empty string; texts of any length are cut as a whole, in
time linear in them; repeated rows are transformed alike; further columns stay, those named
like the results are replaced; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.llm.texts import has_columns

# The marks, and percentages of documents.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
MARK_BYTES = 3
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = "1"

SHORTEST_CHUNK, LONGEST_CHUNK = 64, 4096
CUT_BITS = 9  # one place in 2**9 is a cut
WINDOW_STEPS = 4  # the rolling hash sees 2**4 bytes
CACHE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Chunk:
    """What is kept of a chunk's content."""

    chars: int
    marked: bool
    head: bytes
    tail: bytes


def byte_weights(seed: int = 7) -> np.ndarray:
    """A pseudorandom number for every byte."""
    return np.random.default_rng(seed).integers(1, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


WEIGHTS = byte_weights()


def rolling_hash(data: np.ndarray, steps: int = WINDOW_STEPS) -> np.ndarray:
    """For every place, the hash of the 2**steps bytes that end there (fewer at the beginning)."""
    found = WEIGHTS[data]
    for step in range(steps):
        width = 1 << step
        longer = found.copy()
        longer[width:] += found[:-width] << np.uint32(width) if width < len(found) else np.uint32(0)
        found = longer
    return found


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of a text end: at cuts of the rolling hash, not inside a character, and
    neither nearer nor farther than the limits."""
    size = len(data)
    hashed = rolling_hash(data)
    # the high bits depend on all bytes of the window
    cuts = np.flatnonzero(hashed >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, last = [], 0
    for cut in cuts.tolist():
        if cut - last < SHORTEST_CHUNK:
            continue
        while cut - last > LONGEST_CHUNK:
            last = _whole_character(data, last + LONGEST_CHUNK)
            ends.append(last)
        cut = _whole_character(data, cut)
        if cut - last >= SHORTEST_CHUNK and cut < size:
            ends.append(cut)
            last = cut
    while size - last > LONGEST_CHUNK:
        last = _whole_character(data, last + LONGEST_CHUNK)
        ends.append(last)
    if size > last:
        ends.append(size)
    return ends


def _whole_character(data: np.ndarray, place: int) -> int:
    """The next place that does not lie inside a character."""
    while place < len(data) and data[place] & 0xC0 == 0x80:
        place += 1
    return place


class ChunkCache:
    """What is known of chunks, by their content; two generations bound its size."""

    def __init__(self, most_bytes: int = CACHE_BYTES):
        self.most_bytes, self.held = most_bytes, 0
        self.young: dict[bytes, Chunk] = {}
        self.old: dict[bytes, Chunk] = {}
        self.hits = self.misses = 0

    def __getitem__(self, content: bytes) -> Chunk:
        known = self.young.get(content)
        if known is not None:
            self.hits += 1
            return known
        known = self.old.get(content)
        if known is None:
            self.misses += 1
            known = Chunk(len(content.decode("utf-8")), any(mark in content for mark in MARKS),
                          content[:MARK_BYTES - 1], content[1 - MARK_BYTES:])
        else:
            self.hits += 1
        if self.held > self.most_bytes // 2:
            self.young, self.old, self.held = {}, self.young, 0
        self.young[content] = known
        self.held += len(content) + 200
        return known


class CutText:
    """A text as chunks: its number of code points, and where the k-th of them begins."""

    def __init__(self, text: bytes, cache: ChunkCache):
        self.text = text
        self.ends = chunk_ends(np.frombuffer(text, dtype=np.uint8)) if text else []
        self.marked, start, edge = False, 0, b""
        counts = []
        for end in self.ends:
            content = text[start:end]
            known = cache[content]
            counts.append(known.chars)
            # a mark across chunks lies in the last bytes before and the first bytes after their border
            seam = edge + known.head
            self.marked = self.marked or known.marked or any(mark in seam for mark in MARKS)
            edge = (edge + known.tail)[1 - MARK_BYTES:]
            start = end
        self.upto = np.cumsum(counts, dtype=np.int64)
        self.chars = int(self.upto[-1]) if counts else 0

    def place(self, k: int) -> int:
        """The byte at which code point ``k`` begins; ``chars`` is the end."""
        if k >= self.chars:
            return len(self.text)
        no = int(np.searchsorted(self.upto, k, side="right"))
        start, before = (self.ends[no - 1], int(self.upto[no - 1])) if no else (0, 0)
        content = self.text[start:self.ends[no]]
        return start + len(content.decode("utf-8")[:k - before].encode("utf-8"))


def draws(doc_id, seed: str = SEED) -> list[int]:
    """Four numbers below 2**32 for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def transformed(text: bytes, drawn: list[int], cache: ChunkCache, share: int, suffix_first: int):
    """``n``, ``form``, ``prefix_chars``, ``middle_chars`` and the output of one text."""
    cut = CutText(text, cache)
    n = cut.chars
    if not text or cut.marked or drawn[2] % 100 >= share:
        return n, "plain", None, None, text
    first, second = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = cut.place(first), cut.place(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if drawn[3] % 100 < suffix_first:
        return n, "spm", first, second - first, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", first, second - first, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(df: DataFrame, text: str = "text", key: str = "doc_id", seed: str = SEED, share: int = TRANSFORMED,
                   suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Add ``n``, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    ``share`` percent of the documents are transformed, ``suffix_first`` percent of these with
    the suffix first; both and the cuts are drawn from ``seed`` and ``key``.
    """
    has_columns(df, text, key)
    kept = [c for c in df.columns if c not in RESULTS]
    others = [c for c in kept if c != text]
    # the columns in one struct: none of them can clash with a name used here
    rows = df.select(F.struct(*[df[c] for c in others]).alias("given"), df[key].cast("string").alias("key"), df[text].alias("text"))
    schema = "given " + rows.schema["given"].dataType.simpleString()

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache()
        for batch in batches:
            keys, texts = batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            start, size, found = 0, 0, []
            for at, key_text in enumerate(keys):
                found.append(transformed(texts[at].as_py() or b"", draws(key_text, seed), cache, share, suffix_first))
                size += len(found[-1][4])
                if size > BATCH_BYTES or at + 1 == len(keys):
                    yield _as_batch([batch.column(i).slice(start, at + 1 - start) for i in (0, 2)], found)
                    start, size, found = at + 1, 0, []

    added = "n long, form string, prefix_chars long, middle_chars long, output string"
    done = rows.mapInArrow(results, f"{schema}, text string, {added}")
    columns = [F.col("text").alias(c) if c == text else F.col("given").getField(c).alias(c) for c in kept]
    return done.select(*columns, *RESULTS)


def _as_batch(given: list[pa.Array], found: list[tuple]) -> pa.RecordBatch:
    n, form, prefix, middle, output = zip(*found)
    return pa.RecordBatch.from_arrays(
        [*given, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
         pa.array([o.decode("utf-8") for o in output])], names=["given", "text", *RESULTS])


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone."""
    parts = F.split(output, "|".join(mark.decode() for mark in MARKS), -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS txt, length(coalesce(text, ''))::BIGINT AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
  SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
    ('0x' || h[25:32])::BIGINT AS h4 FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(txt, '<P>') OR contains(txt, '<S>') OR contains(txt, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, substring(txt, 1, a) AS p, substring(txt, a + 1, b - a) AS m, substring(txt, b + 1) AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN txt WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(txt) AS restored_sha256
FROM parts
"""


def op11_fill_in_middle(spark, sf_dir):
    """Every document transformed, and the text rebuilt from the output."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fill_in_middle(documents).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
