"""Mixing sources to target weights by multinomial draws and index permutations.

The words of a source, its documents in a seeded order, are packed into blocks of fixed
length.  Every output shard draws the source of each of its slots; the counts per shard and
source are multinomial.  Where the counts of all shards together miss a source's quota, the
last slots of the sources above it go to those below, so that quotas are met exactly.  The
slots of a source, numbered over all shards, run through a seeded permutation of its block
numbers, and through another one each time the source begins anew; slots and blocks are
joined by source and block number.

Only sizes, slots and block numbers are shuffled.  No window or group holds a source:
running totals go by buckets, draws are counted per shard before they are numbered.  The
table of sources (a row each) is the only thing ordered as a whole.

Cases: a null text has no words; a document without words takes no part (0 words taken); a
null source is a source, the last one; repeated rows are documents of their own; ties in the
seeded order go by doc_id and size; an empty table gives an empty mix; further columns stay
in the mixed documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriscope.llm.ranks import HASH_RANGE, running_totals
from veriscope.llm.row_keys import keyed
from veriscope.llm.texts import BLANKS, WORD, has_columns, let, word_count
from veriscope.shared import broadcast_if_small, settle

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 64
SHARD_BITS = 14  # slots of a shard, as a power of two
TASK_BITS = 17  # slots that a task numbers, as a power of two
SEED = 42
ROUNDS = 12
GRID = 4096
# Two primes below 2**31, and factors for mixing numbers in 64-bit arithmetic.
PRIME, OTHER_PRIME, FACTOR, OTHER_FACTOR = 2_147_483_647, 2_147_483_563, 48_271, 40_692


def scrambled(number: Column, key: int) -> Column:
    """A pseudorandom number in [0, PRIME) for a whole ``number``."""
    spread = (F.pmod(number, F.lit(PRIME)) + F.pmod(number, F.lit(OTHER_PRIME)) * OTHER_FACTOR + key) % PRIME
    return let(spread, lambda y: let(y * y % PRIME, lambda z: (z * z % PRIME * y % PRIME * FACTOR + key) % PRIME))


def permuted(number: Column, size: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The place of ``number`` (below ``size``) in a permutation given by ``key``.

    A swap-or-not shuffle: each round pairs the numbers x and (k - x) mod n and swaps a
    pseudorandom half of the pairs, which permutes any range without rejections.
    """
    def one_round(x: Column, i: Column) -> Column:
        partner = ((key + i) * (FACTOR + 2 * i) % PRIME % size - x + size) % size
        return let(partner, lambda other: let(
            (F.greatest(x, other) + key * (2 * i + 1)) % PRIME,
            lambda top: F.when(top * top % PRIME * top % PRIME % 2 == 1, other).otherwise(x)))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(rounds).cast("long")), number, one_round)


def source_targets(sized: DataFrame, weights=WEIGHTS, most_repeats: int = MOST_REPEATS,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per source: ``source_no``, ``source_size``, ``target``, ``n_blocks`` and its ``quota`` of blocks.

    Sources share all words by weight; one that would repeat too often stops at its limit
    and the rest share what it leaves.  Ordered by limit per weight, the stopped ones come first.
    """
    whole = Window.partitionBy(F.lit(0))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sizes.withColumn("source_no", F.row_number().over(whole.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    limited = ranked.withColumn("weight", weight).withColumn("_limit", most_repeats * F.col("source_size"))
    tight_first = whole.orderBy(F.col("_limit") / F.col("weight"), "source_no")
    rest = F.sum("source_size").over(whole) - (F.sum("_limit").over(tight_first.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_limit"))
    heavier = F.sum("weight").over(tight_first.rowsBetween(0, Window.unboundedFollowing))
    shared = limited.withColumn("_stopped", F.col("weight") * rest / heavier > F.col("_limit"))
    left = F.sum("source_size").over(whole) - F.sum(F.when(F.col("_stopped"), F.col("_limit")).otherwise(0)).over(whole)
    sharing = F.sum(F.when(F.col("_stopped"), 0).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("_stopped"), F.col("_limit").cast("double")).otherwise(
        F.coalesce(F.col("weight") * F.try_divide(left, sharing), F.lit(0.0)))
    n_blocks = F.ceil(F.col("source_size") / block_words)
    quota = F.when(F.col("source_size") > 0, F.floor(F.col("target") * n_blocks / F.col("source_size") + 0.5)).otherwise(0)
    return shared.withColumn("target", target).select(
        "source", F.col("source_no").cast("long"), "source_size", "target",
        n_blocks.cast("long").alias("n_blocks"), quota.cast("long").alias("quota"))


def drawn_slots(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """The slots of all shards: ``shard``, ``source_no``, ``r`` (the slot's number within its source).

    ``sources`` is settled.  Every source gets exactly the numbers below its quota.
    """
    spark = sources.sparkSession
    slots = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    before = Window.partitionBy(F.lit(0)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("quota").over(before)
    shares = sources.where("quota > 0").select(
        "source_no", "quota", ((upto - F.col("quota")) / F.lit(float(max(1, slots)))).alias("low"),
        (upto / F.lit(float(max(1, slots)))).alias("high"))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * GRID), F.floor(F.col("high") * GRID))))
    drawn = spark.range(slots).select(
        F.shiftright("id", SHARD_BITS).alias("shard"), (scrambled(F.col("id"), seed) / float(PRIME)).alias("u"))
    # the grid turns the search for the share into an equality join
    counts = settle(
        drawn.withColumn("cell", F.floor(F.col("u") * GRID))
        .join(broadcast_if_small(settle(cells)), "cell").where("u >= low AND u < high")
        .groupBy("source_no", "shard").agg(F.count("*").alias("n")))
    shards = (slots >> SHARD_BITS) + 1
    place = F.col("shard") * (HASH_RANGE // shards)
    first = running_totals(counts, "source_no", place, F.col("n"), ["shard"], counts.count(), "first")
    # a row per source and shard is dealt to the tasks before it becomes one per slot
    tasks = max(min(shards, spark.sparkContext.defaultParallelism), slots >> TASK_BITS)
    numbered = first.repartition(tasks, "source_no", "shard").withColumn(
        "r", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    drawn_total = counts.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    gaps = settle(
        sources.where("quota > 0").join(drawn_total, "source_no", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)))
        .withColumn("under", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
        .select("source_no", "quota", "drawn", "under",
                (F.sum("over").over(before) - F.col("over")).alias("over_from"),
                (F.sum("under").over(before) - F.col("under")).alias("under_from")))
    known = numbered.select("shard", "source_no", "r").join(
        broadcast_if_small(gaps).select("source_no", "quota", "over_from"), "source_no")
    kept = known.where("r < quota").select("shard", "source_no", "r")
    spare = known.where("r >= quota").select("shard", (F.col("over_from") + F.col("r") - F.col("quota")).alias("spare_no"))
    open_places = gaps.where("under > 0").select("source_no", F.posexplode(F.sequence(
        F.col("under_from"), F.col("under_from") + F.col("under") - 1)).alias("_i", "spare_no"), "drawn")
    moved = spare.join(open_places, "spare_no").select("shard", "source_no", (F.col("drawn") + F.col("_i")).alias("r"))
    return kept.unionByName(moved)


def mixed_blocks(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as blocks: ``shard``, ``source_no``, ``epoch``, ``block``."""
    sizes = broadcast_if_small(sources).select("source_no", "n_blocks")
    epoch = F.floor(F.col("r") / F.col("n_blocks"))
    key = scrambled(F.col("source_no") * MOST_REPEATS + F.col("epoch"), seed)
    return (
        drawn_slots(sources, seed).join(sizes, "source_no").withColumn("epoch", epoch).withColumn("_key", key)
        .select("shard", "source_no", "epoch",
                permuted(F.col("r") - F.col("epoch") * F.col("n_blocks"), F.col("n_blocks"), F.col("_key")).alias("block"))
    )


class Mix:
    """Sized documents, their sources and the drawn blocks."""

    def __init__(self, rows: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = SEED):
        """``rows`` has ``_row`` (unique), ``doc_id``, ``source`` and ``size``; it is settled here."""
        self.block_words = block_words
        self.rows = settle(rows, compact=True)
        self.sources = settle(source_targets(self.rows, weights, MOST_REPEATS, block_words))
        self.blocks = mixed_blocks(self.sources, seed)
        known = broadcast_if_small(self.sources).select(F.col("source").alias("_source"), "source_no", "source_size", "target")
        self.placed = self.rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def pieces(self) -> DataFrame:
        """Where the words of each document lie: ``_row``, ``source_no``, ``block``, and the
        document's words ``low`` to ``high`` (exclusive) in that block."""
        place = scrambled(F.coalesce("doc_id", F.lit(-1)), SEED)
        located = running_totals(self.placed.where("size > 0"), "source_no", place, F.col("size"), ["doc_id", "size", "_row"],
                                 self.rows.count(), "begin")
        width = F.lit(self.block_words)
        first, last = F.floor(F.col("begin") / width), F.floor((F.col("begin") + F.col("size") - 1) / width)
        cut = located.withColumn("block", F.explode(F.sequence(first, last)))
        return cut.withColumns({
            "low": F.greatest(F.col("block") * width - F.col("begin"), F.lit(0)),
            "high": F.least((F.col("block") + 1) * width - F.col("begin"), F.col("size")),
        })

    def taken(self) -> DataFrame:
        """Every document with ``source_size``, ``target`` and ``taken``."""
        times = self.blocks.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        keys = ("_row", "doc_id", "size", "source_size", "target")
        words = self.pieces().join(times, ["source_no", "block"], "left").groupBy(*keys).agg(
            F.sum((F.col("high") - F.col("low")) * F.coalesce("times", F.lit(0))).alias("taken"))
        without = self.placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
        return words.unionByName(without)

    def runs(self) -> DataFrame:
        """The words taken, as runs of each document: ``_row`` and ``_runs``, an array of
        (epoch, low, high, whole) in order."""
        found = self.pieces().join(self.blocks.select("source_no", "block", "epoch"), ["source_no", "block"])
        span = F.struct("epoch", "low", "high", "size")
        spans = found.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("_spans"))

        def other(i: Column, field: str) -> Column:
            return F.get("_spans", i)[field]

        # of neighbouring spans, one run: from a span that continues none to one that none continues
        begin = F.filter("_spans", lambda s, i: F.coalesce(
            (other(i - 1, "epoch") != s["epoch"]) | (other(i - 1, "high") != s["low"]), F.lit(True)))
        end = F.filter("_spans", lambda s, i: F.coalesce(
            (other(i + 1, "epoch") != s["epoch"]) | (other(i + 1, "low") != s["high"]), F.lit(True)))
        joined = F.zip_with(begin, end, lambda a, b: F.struct(
            a["epoch"].alias("epoch"), a["low"].alias("low"), b["high"].alias("high"),
            ((a["low"] == 0) & (b["high"] == a["size"])).alias("whole")))
        return spans.select("_row", joined.alias("_runs"))


def sized(df: DataFrame, *keep: str) -> DataFrame:
    """Row number, doc_id, source and size of every document."""
    has_columns(df, "doc_id", "source", "text")
    row = F.col("_row") if "_row" in df.columns else F.monotonically_increasing_id()
    return df.select(row.alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("size"), *keep)


def spaced_words(text: Column) -> Column:
    """The words with the white space after them (and before the first): joined, they are the text."""
    blank = f"[{''.join(f'{chr(92)}x{ord(c):02x}' for c in BLANKS)}]"
    return F.regexp_extract_all(text, F.lit(rf"(?:^{blank}+)?{WORD}{blank}*"), F.lit(0))


def mixed_documents(df: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as documents: what it takes of each, a row per pass over the source and run of words.

    A document taken whole keeps its text as it is; of another, the words are found once for
    all its runs.  ``n_chars``, if there, is set anew.
    """
    has_columns(df, "doc_id", "source", "text")
    stored = keyed(df)
    runs = Mix(sized(stored.select("_row", "_given.doc_id", "_given.source", "_given.text")), weights, block_words, seed).runs()
    text = F.col("_given.text")

    def part(run: Column, found: Column) -> Column:
        own = F.transform(F.sequence(run["low"], run["high"] - 1), lambda k: F.get(found, k.cast("int")))
        return F.when(run["whole"], text).otherwise(F.array_join(own, ""))

    parts = F.when(F.forall("_runs", lambda run: run["whole"]), F.transform("_runs", lambda run: text)).otherwise(
        let(spaced_words(text), lambda found: F.transform("_runs", lambda run: part(run, found))))
    result = stored.join(runs, "_row").select("_given", F.explode(parts).alias("_part"))
    columns = {c: F.col("_given").getField(c) for c in df.columns} | {"text": F.col("_part")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("_part").cast(df.schema["n_chars"].dataType)
    return result.select(*[column.alias(name) for name, column in columns.items()])


def _scramble_steps(number: str, key: int, name: str) -> list[tuple[str, str]]:
    """``scrambled`` as steps of SQL."""
    spread = [f"((({number}) % {p} + {p}) % {p})" for p in (PRIME, OTHER_PRIME)]
    return [
        ("_y", f"({spread[0]} + {spread[1]} * {OTHER_FACTOR} + {key}) % {PRIME}"), ("_z", f"_y * _y % {PRIME}"),
        (name, f"(_z * _z % {PRIME} * _y % {PRIME} * {FACTOR} + {key}) % {PRIME}"),
    ]


def _permutation_steps() -> list[tuple[str, str]]:
    """``permuted`` as steps of SQL."""
    steps = [("epoch", "r // n_blocks"), ("block", "r - epoch * n_blocks"),
             *_scramble_steps(f"source_no * {MOST_REPEATS} + epoch", SEED, "_key")]
    for i in range(1, ROUNDS + 1):
        steps += [
            ("_other", f"((_key + {i}) * {FACTOR + 2 * i} % {PRIME} % n_blocks - block + n_blocks) % n_blocks"),
            ("_top", f"(greatest(block, _other) + _key * {2 * i + 1}) % {PRIME}"),
            ("block", f"CASE WHEN _top * _top % {PRIME} * _top % {PRIME} % 2 = 1 THEN _other ELSE block END"),
        ]
    return steps


def _nested(table: str, steps: list[tuple[str, str]]) -> str:
    """The steps as nested SQL."""
    names: list[str] = []
    for name, expression in steps:
        keep = f"* EXCLUDE ({name})" if name in names else "*"
        table = f"(SELECT {keep}, ({expression})::BIGINT AS {name} FROM {table})"
        names.append(name)
    return table


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
  FROM sized GROUP BY source
), limited AS (
  SELECT *, CASE source_no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS lim FROM ranked
), stops AS (
  SELECT *, weight * (sum(source_size) OVER () - (sum(lim) OVER w - lim))
    / (sum(weight) OVER () - (sum(weight) OVER w - weight)) > lim AS stopped
  FROM limited WINDOW w AS (ORDER BY lim / weight, source_no ROWS UNBOUNDED PRECEDING)
), targets AS (
  SELECT *, CASE WHEN stopped THEN lim::DOUBLE ELSE weight * ((sum(source_size) OVER () - sum(CASE WHEN stopped THEN lim ELSE 0 END) OVER ())
    / sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER ()) END AS target,
    ceil(source_size / {BLOCK_WORDS})::BIGINT AS n_blocks
  FROM stops
), quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target * n_blocks / source_size + 0.5) ELSE 0 END::BIGINT AS quota FROM targets
), slots AS (
  SELECT source_no, n_blocks, unnest(range(quota)) AS r FROM quotas
), times AS (
  SELECT source_no, block, count(*) AS times FROM {_nested("slots", _permutation_steps())} GROUP BY ALL
), places AS (
  SELECT * EXCLUDE (_y, _z) FROM {_nested("(SELECT s.*, source_no, source_size, target FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source)",
                                            _scramble_steps("coalesce(doc_id, -1)", SEED, "place"))}
), located AS (
  SELECT *, sum(size) OVER (PARTITION BY source_no ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM places
), pieces AS (
  SELECT *, unnest(range((start // {BLOCK_WORDS})::BIGINT, ((start + size - 1) // {BLOCK_WORDS} + 1)::BIGINT)) AS block FROM located WHERE size > 0
), taken AS (
  SELECT doc_id, sum((least((p.block + 1) * {BLOCK_WORDS} - start, size) - greatest(p.block * {BLOCK_WORDS} - start, 0)) * coalesce(times, 0))::BIGINT AS taken
  FROM pieces p LEFT JOIN times t ON p.source_no = t.source_no AND p.block = t.block GROUP BY doc_id
)
SELECT l.doc_id, size::BIGINT AS size, source_size, target, coalesce(t.taken, 0)::BIGINT AS taken
FROM located l LEFT JOIN taken t ON l.doc_id = t.doc_id
"""


def op1_mixing(spark, sf_dir):
    """All documents and the words that the mix takes of each."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Mix(sized(documents)).taken().select("doc_id", "size", "source_size", "target", "taken")
