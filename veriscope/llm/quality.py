"""Quality rules: a table of thresholds compiled into one projection.

A rule compares a share of two counts of a text (percent of ``whole``) with a lower and an
upper limit.  All counts come from the text in one pass of native expressions; no rows move.

Cases: a null text has no words; a text without words fails on length; repeated lines and
windows are counted within the text alone; repeated rows are judged alike; columns of the
input are kept, and those named like a count or the verdict are replaced; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.llm.texts import has_columns, let, run_of, word_count, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as was be by are "
    "der die das und von zu den mit ist im für auf nicht ein eine "
    "le la les de des et un une est dans que pour en du "
    "el los las y por una del se con no su al"
).split()


@dataclass(frozen=True)
class Rule:
    """``low`` <= 100 * part / whole <= ``high``; a missing limit holds; the whole ``one`` is 1."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def holds(self) -> Column:
        part, whole = 100 * F.col(self.part), F.lit(1) if self.whole == "one" else F.col(self.whole)
        held = F.lit(True)
        if self.low is not None:
            held = held & (part >= self.low * whole)
        if self.high is not None:
            held = held & (part <= self.high * whole)
        return held


BASE_RULES = (
    Rule("long_enough", "n_words", "one", low=20 * 100),
    Rule("little_repetition", "n_repeat_words", "n_words", high=30),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("few_symbols", "n_symbols", "n_words", high=20),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("few_repeated_lines", "n_dup_lines", "n_lines", high=50),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def _covered(places: Column, size: int) -> Column:
    """How many places lie in windows of ``size`` that begin at the sorted ``places``."""
    return F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(size), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


def _beside_equal(items: Column, key) -> Column:
    """Of sorted ``items``, those whose neighbour has the same key."""
    return F.filter(items, lambda item, i: (
        F.coalesce(key(F.get(items, i - 1)) == key(item), F.lit(False))
        | F.coalesce(key(F.get(items, i + 1)) == key(item), F.lit(False))
    ))


def repeated_words(found: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of ``size`` words that occur twice or more in the text.

    Hashes point out the windows that may repeat; only those are compared word by word.
    """
    starts = F.when(F.size(found) >= size, F.sequence(F.lit(0), F.size(found) - size)).otherwise(
        F.array().cast("array<int>"))

    def exact(suspects: Column) -> Column:
        spelled = F.sort_array(F.transform(suspects, lambda s: F.struct(
            F.concat_ws(" ", *run_of(found, s["at"], size)).alias("key"), s["at"].alias("at"))))
        return let(spelled, lambda x: _covered(
            F.sort_array(F.transform(_beside_equal(x, lambda s: s["key"]), lambda s: s["at"])), size))

    def by_hash(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("key"), i.alias("at"))))
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, let(ordered, lambda x: exact(_beside_equal(x, lambda s: s["key"])))).otherwise(0)

    hashes = F.transform(starts, lambda i: F.xxhash64(*run_of(found, i, size)))
    return let(hashes, by_hash)


def with_counts(df: DataFrame, text: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """Add the counts that the rules look at."""
    has_columns(df, text)
    both_cases = [*stop_words, *(w.capitalize() for w in stop_words)]
    whole = F.coalesce(df[text], F.lit(""))
    given = [c for c in df.columns if c not in COUNTS]
    # the columns in one struct: none of them can clash with a name used here
    parts = df.select(F.struct(*[df[c] for c in given]).alias("_given") if given else F.lit(None).alias("_given"), whole.alias("_whole"))
    whole = F.col("_whole")
    parts = parts.withColumns({
        "_words": words(whole),
        "_lines": F.filter(F.split(whole, "\n"), lambda line: word_count(line) > 0),
        "n_symbols": F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")),
    })
    counted = parts.withColumns({
        "n_words": F.size("_words"),
        "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_lines": F.size("_lines"),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(both_cases))),
        # depends on the row's place by name, so that a filter on the verdict is not pushed below
        # and does not compute the counts again
        "n_repeat_words": F.when(F.monotonically_increasing_id() >= 0, repeated_words(F.col("_words"))),
    })
    return counted.select(*[F.col("_given").getField(c).alias(c) for c in given], *[F.col(c).cast("long").alias(c) for c in COUNTS])


def judged(df: DataFrame, text: str = "text", rules=RULES, base_rules=BASE_RULES) -> DataFrame:
    """Add the counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    counted = with_counts(df.drop("base_failed", "failed_rules", "kept"), text)
    base = F.lit(False)
    for rule in base_rules:
        base = base | ~rule.holds()
    failed = F.filter(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in (*base_rules, *rules)]), F.isnotnull)
    return counted.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn(
        "kept", F.size("failed_rules") == 0)


def passed(df: DataFrame, text: str = "text", rules=RULES, base_rules=BASE_RULES) -> DataFrame:
    """The rows that pass every rule, with their own columns only."""
    has_columns(df, text)
    whole = df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("text"))
    return judged(whole, "text", rules, base_rules).where("kept").select("_row.*")


ORACLE = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS txt, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM texts)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), counts AS (
  SELECT t.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(txt, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(txt, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines,
    len(list_filter(ws, lambda w: list_contains({[*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]}, w))) AS n_stop_words
  FROM texts t LEFT JOIN covered c ON t.doc_id = c.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1200 * n_words
    AND 100 * n_symbols <= 20 * n_words AND 100 * n_stop_words >= 2 * n_words
    AND 100 * n_dup_lines <= 50 * n_lines AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
"""


def op2_quality_rules(spark, sf_dir):
    """Every document with its counts and the verdict of the rules."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(documents.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
