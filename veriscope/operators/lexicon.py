"""Per-text scores from word lists, in one scan and one shuffle of narrow rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.functions.text import (
    NATIVE_FEATURES, SUPERLATIVES, filled, with_native_features, words,
)
from veriscope.shared import MAX_BROADCAST_ROWS, fits_broadcast

# Words that turn the polarity of the next word, and by how much.
NEGATORS = ("no", "not", "never")
NEGATION_FACTOR = -0.5

# Past the broadcast bound, a frequent word's tokens are spread over this many tasks.
SALTS = 64


def join_lexicon(tokens: DataFrame, lexicon: DataFrame, spread_by: str,
                 max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Left-join settled word scores to tokens on ``word``.

    A lexicon under the checked bound is broadcast.  A larger one is joined by word
    and salt, so that the tokens of a very frequent word do not meet in one task.
    """
    if fits_broadcast(lexicon, max_rows):
        return tokens.join(F.broadcast(lexicon), "word", "left")
    salted = tokens.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    copies = lexicon.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["word", "_salt"], "left").drop("_salt")


def token_items(measured: DataFrame, columns: Sequence[str], negators: Sequence[str] = NEGATORS) -> DataFrame:
    """Both tokenisations of every text as rows (columns…, word, spoken, negated).

    ``_raw`` are the whitespace words, ``_letters`` the alphabetic tokens.  No lambda: those are
    interpreted for every element.
    """
    both = measured.select(*columns, "_letters", F.size("_raw").alias("_n"), F.posexplode_outer(F.concat("_raw", "_letters")).alias("_at", "word"))
    place = F.col("_at") - F.col("_n")
    spoken = place >= 0
    before = F.get("_letters", place - 1)
    return both.select(*columns, "word", spoken.alias("spoken"), F.coalesce(spoken & before.isin(list(negators)), F.lit(False)).alias("negated"))


def lexicon_scores() -> list[Column]:
    """Aggregates over the joined tokens of one text."""
    raw, spoken = ~F.col("spoken"), F.col("spoken")
    tone = F.col("polarity") * F.when(F.col("negated"), NEGATION_FACTOR).otherwise(1.0)
    n_words = F.greatest(F.count_if(spoken), F.lit(1))
    n_adjectives = F.count_if(spoken & (F.col("pos") == "ADJ"))
    n_nouns = F.count_if(spoken & (F.col("pos") == "NOUN"))
    return [
        F.avg(F.when(raw, F.col("concreteness"))).alias("concreteness_score"),
        F.coalesce(F.avg(F.when(spoken, tone)), F.lit(0.0)).alias("polarity"),
        (n_adjectives / n_words).alias("adj_ratio"),
        (n_nouns / n_words).alias("noun_ratio"),
        (n_adjectives / F.greatest(n_nouns, F.lit(1))).alias("adj_noun_ratio"),
    ]


def text_profile(texts: DataFrame, lexicon: DataFrame, carry: Sequence[str] = (), text: str = "text_",
                 key: str = "id", superlatives: Sequence[str] = SUPERLATIVES,
                 negators: Sequence[str] = NEGATORS, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Every text feature of every text: the native ones and the lexicon scores.

    With a lexicon under the broadcast bound the measurements ride along with the
    exploded tokens, so the text is read once and never shuffled, and per-text sums
    are combined before the one shuffle.
    ``lexicon`` is a settled table (word, concreteness, polarity, pos); a missing
    word scores NULL.
    """
    base = [key, *carry, *NATIVE_FEATURES]
    measured = (
        with_native_features(texts, text, superlatives)
        .withColumn("_raw", F.array_remove(F.split(F.lower("_plain"), " "), ""))
    )
    if fits_broadcast(lexicon, max_rows):
        # numbers, unlike strings, can be held in a hash aggregate's buffer
        same_text = [F.max(c).alias(c) for c in NATIVE_FEATURES]
        tokens = token_items(measured, base, negators).join(F.broadcast(lexicon), "word", "left")
        return tokens.groupBy(key, *carry).agg(*same_text, *lexicon_scores())
    # the tokens are shuffled to the lexicon: they travel without the measurements
    tokens = join_lexicon(token_items(measured, [key], negators), lexicon, key, max_rows)
    return measured.select(*base).join(tokens.groupBy(key).agg(*lexicon_scores()), key)


def merge_lexicons(concreteness: DataFrame, polarity: DataFrame, parts: DataFrame) -> DataFrame:
    """One word table from three word lists."""
    return (
        concreteness.select("word", "concreteness")
        .join(polarity.select("word", "polarity"), "word", "full")
        .join(parts.select("word", "pos"), "word", "full")
    )


def mean_word_score(texts: DataFrame, lexicon: DataFrame, score: str, text: str = "text_",
                    key: str = "id", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mean score of a text's known whitespace words; NULL if it has none."""
    tokens = texts.select(key, F.explode_outer(words(F.lower(filled(F.col(text))))).alias("word"))
    scored = join_lexicon(tokens, lexicon.select("word", score), key, max_rows)
    return scored.groupBy(key).agg(F.avg(score).alias(score))
