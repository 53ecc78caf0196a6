"""Phrases that are more than their parts, counted in quotient filters.

Words that are frequent by language get numbers; texts become sequences of numbers, with a
break at every rarer word and every end of a piece (a phrase as frequent as asked has none of
these inside).  Phrases grow by a word a round: those of n words are counted only where both
phrases of n - 1 words in them may be frequent, as a table of bits of fixed size says.  It may
say so wrongly, which costs a counter and changes nothing.  Every task counts in a quotient
filter and sends it in ranges of keys; each range's filters are merged, and what reaches the
threshold is unpacked.

Cases: a null text is an empty one; a null language is the language ``und``; texts without
words have no phrases; pieces and words of any length are taken whole; repeated rows count
again; ties end with the phrase in order of its bytes; further columns are ignored; an empty
table has no phrases.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriscope.llm.quotient_filters import Filter, Packing
from veriscope.llm.ranks import HASH_RANGE, running_totals
from veriscope.llm.texts import has_columns
from veriscope.shared import broadcast_if_small, fits_broadcast, settle

MOST_WORDS = 5
LEAST_COUNT = 100
KEPT_PHRASES = 2000
SWALLOWED = 100  # percent of a phrase's occurrences that lie in a longer one
SCALE = 1000
NO_LANGUAGE = "und"
SEPARATORS = b".,;:!?\n\x0b\x0c\r"

MOST_NUMBERED = 1 << 25  # words whose numbers fit a key of five
COUNTED_WORDS, COUNTED_BYTES = 300_000, 64 << 20  # of a task's word counts, before it passes them on
COUNTED_PHRASES = 2 << 20
RANGE_KEYS = 1 << 20  # words of text for every range of keys
SEGMENT_WORDS = 4096
TABLE_BITS = 27
BREAK = b"\xff"  # no byte of a text

_plain = bytearray(range(256))
for _upper in range(65, 91):
    _plain[_upper] = _upper + 32
for _end in SEPARATORS:
    _plain[_end] = BREAK[0]
_plain[9] = 32
PLAIN = bytes(_plain)


def words_and_breaks(text: bytes | None) -> list[bytes]:
    """The words of a text, with ``BREAK`` between pieces."""
    return (text or b"").translate(PLAIN).replace(BREAK, b" \xff ").split()


def _spoken(df: DataFrame, text: str, lang: str) -> DataFrame:
    return df.select(F.coalesce(df[lang].cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), df[text].alias("text"))


def word_counts(spoken: DataFrame) -> DataFrame:
    """``lang``, ``word`` and ``n``; a null word counts all words of the language."""
    def batch_of(counts):
        rows = [(lang, word, n) for lang, found in counts.items() for word, n in found.items()]
        langs, found, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array([w if w is None else w.decode("utf-8") for w in found], pa.string()), pa.array(n, pa.int64())],
            names=["lang", "word", "n"])

    def counted(batches):
        counts, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found, words = counts.setdefault(lang, Counter()), words_and_breaks(text.as_py())
                found.update(words)
                found[None] += len(words) - found.pop(BREAK, 0)
                size += len(text.as_py() or b"")
                if size > COUNTED_BYTES or len(found) > COUNTED_WORDS:
                    yield batch_of(counts)
                    counts, size = {}, 0
        yield batch_of(counts)

    return spoken.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered_words(frequent: DataFrame) -> DataFrame:
    """Settled words with ``id`` from 1 on, without gaps."""
    total = frequent.count()
    if total >= MOST_NUMBERED:
        raise ValueError(f"{total} words reach the least count; {MOST_NUMBERED - 1} can be numbered")
    place = F.pmod(F.xxhash64("lang", "word"), F.lit(HASH_RANGE))
    placed = running_totals(frequent.withColumn("_all", F.lit(0)), "_all", place, F.lit(1).cast("long"), ["lang", "word"], total, "id")
    return settle(placed.select("lang", "word", "n", (F.col("id") + 1).cast("int").alias("id")), compact=True)


def _sequence_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(found, pa.list_(pa.int32())), pa.array([len(f) for f in found], pa.int32())], names=["ids", "starts"])


def _without_repeated_breaks(ids: np.ndarray) -> np.ndarray:
    return ids[(ids != 0) | np.r_[True, ids[:-1] != 0]] if len(ids) else ids


def looked_up(spoken: DataFrame, words: DataFrame) -> DataFrame:
    """Sequences by a dictionary that every task holds (of checked size)."""
    table = words.select("lang", "word", "id").toArrow()
    numbers: dict[str, dict[bytes, int]] = {}
    for lang, word, number in zip(*(c.to_pylist() for c in table.columns)):
        numbers.setdefault(lang, {})[word.encode("utf-8")] = number
    shared = spoken.sparkSession.sparkContext.broadcast(numbers)

    def sequences(batches):
        known, none = shared.value, {}
        for batch in batches:
            found, size = [], 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                get = known.get(lang, none).get
                ids = np.fromiter(map(get, words_and_breaks(text.as_py()), repeat(0)), dtype=np.int32)
                found.append(_without_repeated_breaks(ids))
                size += len(found[-1])
                if size > 1 << 20:
                    yield _sequence_batch(found)
                    found, size = [], 0
            yield _sequence_batch(found)

    return spoken.mapInArrow(sequences, "ids array<int>, starts int")


def joined_up(spoken: DataFrame, words: DataFrame, overlap: int, segment: int = SEGMENT_WORDS) -> DataFrame:
    """Sequences by a join, for dictionaries of any size: texts in segments, each with
    ``overlap`` words of the next one behind its own ``starts``."""
    def segments(batches):
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = [None if w == BREAK else w.decode("utf-8") for w in words_and_breaks(text.as_py())]
                for at in range(0, len(found), segment):
                    own = found[at:at + segment + overlap]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([own], pa.list_(pa.string())), pa.array([min(segment, len(found) - at)], pa.int32())],
                        names=["lang", "words", "starts"])

    cut = settle(spoken.mapInArrow(segments, "lang string, words array<string>, starts int")
                 .withColumn("segment", F.monotonically_increasing_id()), compact=True)
    single = cut.select("segment", "lang", "starts", F.posexplode("words").alias("at", "word"))
    known = single.join(words.select("lang", "word", "id"), ["lang", "word"], "left")
    placed = F.sort_array(F.collect_list(F.struct("at", F.coalesce("id", F.lit(0)).alias("id"))))
    return known.groupBy("segment").agg(placed.alias("_placed"), F.first("starts").alias("starts")).select(
        F.col("_placed.id").alias("ids"), "starts")


def _table_slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left ^ (right << np.uint64(17)) ^ (right >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class BitTable:
    """A table of bits of fixed size: which keys may be frequent."""

    def __init__(self, words: np.ndarray, bits: np.ndarray):
        self.words = np.zeros(1 << (TABLE_BITS - 6), dtype=np.uint64)
        self.words[words] = bits.astype(np.int64).view(np.uint64)

    def has(self, slot: np.ndarray) -> np.ndarray:
        return (self.words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1

    @classmethod
    def of(cls, phrases: DataFrame) -> BitTable:
        """Of settled phrases with a ``slot``; at most 2**21 numbers reach the driver."""
        found = phrases.groupBy(F.shiftright("slot", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
        return cls(found.column("word").to_numpy(), found.column("bits").to_numpy())


def _phrase_starts(ids: np.ndarray, allowed: np.ndarray, words: int, packing: Packing, table: BitTable | None) -> np.ndarray:
    """Where phrases of ``words`` words may begin; ``table`` is of phrases a word shorter."""
    m = len(ids) - words + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    unbroken = allowed[:m].copy()
    for k in range(words):
        unbroken &= ids[k:m + k] != 0
    at = np.flatnonzero(unbroken)
    if table is None or not len(at):
        return at
    shorter = Packing(words - 1, packing.bits)
    for first in (0, 1):
        keys = shorter.permuted(*shorter.packed([ids[at + first + k] for k in range(words - 1)]))
        at = at[table.has(_table_slot(*keys))]
    return at


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All sequences of a batch in one, with a break behind each; and where phrases may begin."""
    lists, starts = batch.column(0), batch.column(1).to_numpy()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    values = lists.flatten().to_numpy()
    inner = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = np.arange(len(values)) + np.repeat(np.arange(len(sizes)), sizes)
    ids, allowed = np.zeros(len(values) + len(sizes), dtype=np.int64), np.zeros(len(values) + len(sizes), dtype=bool)
    ids[places] = values
    allowed[places] = inner < np.repeat(starts, sizes)
    return ids, allowed


def frequent_phrases(sequences: DataFrame, words: int, bits: int, range_bits: int, least: int, table: BitTable | None) -> DataFrame:
    """``ids``, ``a`` (how often) and ``slot`` of all phrases of ``words`` words that occur ``least`` times."""
    packing = Packing(words, bits)
    filters = Filter(packing, min(range_bits, packing.left_bits))
    shared = sequences.sparkSession.sparkContext.broadcast(table)

    def sent(parts) -> Iterator[pa.RecordBatch]:
        left, right, counts = (np.concatenate(c) for c in zip(*parts))
        rows = list(filters.split(*packing.ordered(left, right, counts, merging=True)))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "filter"])

    def counted(batches):
        held, size = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                ids, allowed = _flat(batch.slice(begin, 256))
                at = _phrase_starts(ids, allowed, words, packing, shared.value)
                keys = packing.permuted(*packing.packed([ids[at + k] for k in range(words)]))
                held.append(packing.ordered(*keys, np.ones(len(at), dtype=np.int64)))
                size += len(held[-1][0])
                if size > COUNTED_PHRASES:
                    merged = packing.ordered(*(np.concatenate(c) for c in zip(*held)), merging=True)
                    held, size = [merged], len(merged[0])
                    if size > COUNTED_PHRASES // 2:
                        yield from sent(held)
                        held, size = [], 0
        if held:
            yield from sent(held)

    def merged(group: pa.Table) -> pa.Table:
        found = [filters.decoded(blob.as_py(), part.as_py()) for part, blob in zip(group.column("part"), group.column("filter"))]
        left, right, counts = packing.ordered(*(np.concatenate(c) for c in zip(*found)), merging=True)
        enough = counts >= least
        left, right, counts = left[enough], right[enough], counts[enough]
        numbers = np.stack(packing.unpacked(*packing.restored(left, right)), axis=1).astype(np.int32)
        ids = pa.ListArray.from_arrays(np.arange(0, numbers.size + 1, words, dtype=np.int32), pa.array(numbers.ravel()))
        return pa.table({"ids": ids, "a": pa.array(counts), "slot": pa.array(_table_slot(left, right))})

    return sequences.mapInArrow(counted, "part long, filter binary").groupBy("part").applyInArrow(
        merged, "ids array<int>, a long, slot long")


class Phrases:
    """All frequent words and phrases: ``words`` (lang, word, n, id), ``totals`` (lang, n) and
    ``phrases`` (ids, a) of two words or more."""

    def __init__(self, df: DataFrame, text: str = "text", lang: str = "lang", most_words: int = MOST_WORDS,
                 least: int = LEAST_COUNT, lookup: bool | None = None):
        has_columns(df, text, lang)
        if not 2 <= most_words <= 5:
            raise ValueError("phrases have two to five words")
        spark: SparkSession = df.sparkSession
        spoken = _spoken(df, text, lang)
        counts = settle(word_counts(spoken).where(F.col("word").isNull() | (F.col("n") >= least)), compact=True)
        self.totals = counts.where("word IS NULL").drop("word")
        self.words = numbered_words(counts.where("word IS NOT NULL"))
        largest, occurrences = self.words.agg(F.max("id"), F.sum("n")).first()
        bits = max(1, (largest or 0).bit_length())
        range_bits = max(0, (occurrences or 0) // RANGE_KEYS).bit_length()
        if lookup is None:
            lookup = fits_broadcast(self.words)
        sequences = looked_up(spoken, self.words) if lookup else joined_up(spoken, self.words, most_words - 1)
        sequences = settle(sequences.where(F.size("ids") > 1), compact=True)
        table, rounds = None, []
        for n in range(2, most_words + 1):
            rounds.append(settle(frequent_phrases(sequences, n, bits, range_bits, least, table), compact=True))
            if n < most_words:
                table = BitTable.of(rounds[-1])
        self.phrases = rounds[0].select("ids", "a")
        for found in rounds[1:]:
            self.phrases = self.phrases.unionByName(found.select("ids", "a"))
        self.known = settle(self.phrases.unionByName(
            self.words.select(F.array("id").alias("ids"), F.col("n").alias("a"))).select("ids", F.col("a").alias("f")))

    def scored(self) -> DataFrame:
        """Every phrase at its worst cut: ``ids``, ``a``, ``l``, ``r``, ``n``, ``score``, ``lang``."""
        langs = broadcast_if_small(self.words).select(F.col("id").alias("_id"), "lang")
        known = broadcast_if_small(self.known)
        phrases = self.phrases.withColumn("_id", F.get("ids", F.lit(0))).join(langs, "_id").join(F.broadcast(self.totals), "lang").drop("_id")
        cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
        cuts = cuts.withColumns({"_first": F.slice("ids", 1, F.col("k")), "_rest": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
        cuts = cuts.join(known.select(F.col("ids").alias("_first"), F.col("f").alias("l")), "_first")
        cuts = cuts.join(known.select(F.col("ids").alias("_rest"), F.col("f").alias("r")), "_rest")
        worst = F.min(F.struct(cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r"))
        return cuts.groupBy("lang", "ids", "a", "n").agg(worst.alias("_worst")).select(
            "lang", "ids", "a", "n", "_worst.l", "_worst.r", "_worst.score")

    def swallowed(self, percent: int = SWALLOWED) -> DataFrame:
        """``ids`` of phrases of which ``percent`` of the occurrences lie in one longer phrase."""
        longer = self.phrases.where(F.size("ids") > 2)
        size = F.size("ids")
        parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
            F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("ids", i, n))))
        inner = longer.select(F.explode(parts).alias("ids"), F.col("a").alias("f")).groupBy("ids").agg(F.max("f").alias("f"))
        return inner.join(self.phrases, "ids").where(100 * F.col("f") >= percent * F.col("a")).select("ids")

    def spelled(self, phrases: DataFrame) -> DataFrame:
        """Add ``phrase``, the words with blanks between."""
        words = broadcast_if_small(self.words).select("id", "word")
        placed = F.sort_array(F.collect_list(F.struct("at", "word")))
        texts = phrases.select("ids", F.posexplode("ids").alias("at", "id")).join(words, "id").groupBy("ids").agg(
            F.concat_ws(" ", F.transform(placed, lambda p: p["word"])).alias("phrase"))
        return phrases.join(texts, "ids")


def cut_score(a: Column, n: Column, left: Column, right: Column, scale: int = SCALE) -> Column:
    """floor(scale * a * n / (left * right)), exactly, for counts up to 10**17."""
    def whole(value: Column) -> Column:
        return value.cast("decimal(19,0)")

    product = (whole(a) * whole(n)).cast("decimal(38,0)") * F.lit(scale).cast("decimal(4,0)")
    return F.call_function("div", product.cast("decimal(38,0)"), (whole(left) * whole(right)).cast("decimal(38,0)"))


def collocations(df: DataFrame, kept: int = KEPT_PHRASES, percent: int = SWALLOWED, **how) -> DataFrame:
    """The best phrases of every language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    phrases = Phrases(df, **how)
    candidates = phrases.scored().join(phrases.swallowed(percent), "ids", "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrases.spelled(settle(candidates)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= kept).select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS g
  FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), counts AS (
  SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(ws))::HUGEINT AS n FROM worded GROUP BY lang
), cuts AS (
  SELECT lang, k, g, f AS a, unnest(range(1, k)) AS cut FROM counts WHERE k > 1
), scored AS (
  SELECT c.lang, c.k, c.g, c.a, x.f AS l, y.f AS r, t.n, cut,
    (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:cut]
    JOIN counts y ON y.lang = c.lang AND y.g = c.g[cut + 1:]
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), inner_parts AS (
  SELECT lang, g[i:i + m - 1] AS g, max(f) AS f
  FROM (SELECT lang, g, f, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM counts WHERE k > 2))
  GROUP BY ALL
), ranked AS (
  SELECT w.*, array_to_string(w.g, ' ') AS phrase,
    row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, array_to_string(w.g, ' ')) AS rank
  FROM worst w LEFT JOIN inner_parts p ON w.lang = p.lang AND w.g = p.g WHERE p.f IS NULL OR 100 * p.f < 100 * w.a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


def op12_collocations(spark, sf_dir):
    """The best 2000 phrases of every language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
