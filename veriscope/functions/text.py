"""Text measurements as native column expressions.

Every function takes a string column.  NULL text counts as the empty text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode whitespace that separates words, and token classes.
SPACE_CHARS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
SPACE_RUN = rf"[{SPACE_CHARS}]+"
LETTER_RUN = r"\p{L}+"
TERM = r"[\p{L}\p{N}_]{2,}"
UPPERCASE = r"\p{Lu}"
SENTENCE_END = r"[.!?]+(?:\s|\z)"
NUMBER = r"\d+(?:[.,]\d+)*"  # an amount of money counts as its number
CAPITALISED_RUN = r"[\p{Ll}\p{N},;:)]\s+\p{Lu}[\p{L}'’-]*(?:\s+\p{Lu}[\p{L}'’-]*)*"

# Words counted as superlatives.
SUPERLATIVES = (
    "best", "worst", "greatest", "most", "amazing", "perfect",
    "incredible", "fantastic", "excellent", "awful", "terrible",
)


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def plain(text: Column) -> Column:
    """The text with every run of whitespace as one blank, and none at the ends."""
    return F.trim(F.regexp_replace(filled(text), SPACE_RUN, " "))


def words(text: Column) -> Column:
    """Whitespace-separated words; none for an empty or blank text."""
    return F.array_remove(F.split(plain(text), " "), "")


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(filled(text), F.lit(LETTER_RUN), 0)


def letter_tokens(text: Column) -> Column:
    """Lower-cased purely alphabetic tokens."""
    return letter_runs(F.lower(text))


def terms(text: Column) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(filled(text)), F.lit(TERM), 0)


def char_count(text: Column) -> Column:
    return F.length(filled(text))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def mean_word_length(text: Column) -> Column:
    """Characters that are not whitespace, per word; 0 without words."""
    return F.coalesce(per_word(F.length(F.replace(plain(text), F.lit(" "), F.lit(""))), word_count(text)), F.lit(0.0))


def count_char(text: Column, char: str) -> Column:
    return F.length(filled(text)) - F.length(F.replace(filled(text), F.lit(char), F.lit("")))


def count_pattern(text: Column, pattern: str) -> Column:
    return F.regexp_count(filled(text), F.lit(pattern))


def uppercase_ratio(text: Column) -> Column:
    return count_pattern(text, UPPERCASE) / F.greatest(char_count(text), F.lit(1))


def count_whole_words(text: Column, vocabulary: Sequence[str] = SUPERLATIVES) -> Column:
    """Case-insensitive whole-word matches of any word of a short list."""
    return count_pattern(F.lower(text), whole_words(vocabulary))


def whole_words(vocabulary: Sequence[str]) -> str:
    return rf"\b(?:{'|'.join(map(re.escape, vocabulary))})\b"


def per_word(amount: Column, word_len: Column) -> Column:
    """A density; NULL when there are no words."""
    return F.try_divide(amount.cast("double"), word_len.cast("double"))


def type_token_ratio(text: Column) -> Column:
    tokens = letter_tokens(text)
    return F.size(F.array_distinct(tokens)) / F.greatest(F.size(tokens), F.lit(1))


def sentence_count(text: Column) -> Column:
    """Sentence terminators, plus one for a tail without a terminator."""
    last = F.right(F.rtrim(filled(text), F.lit(" \t\n\x0b\f\r")), F.lit(1))
    return count_pattern(text, SENTENCE_END) + (~last.isin("", ".", "!", "?")).cast("int")


def entity_count(text: Column) -> Column:
    """Stand-in for an entity recogniser: capitalised runs inside a sentence, and numbers."""
    return count_pattern(text, CAPITALISED_RUN) + count_pattern(text, NUMBER)


def wrapped(text: Column, per_line: int = 10, separator: str = "<br>") -> Column:
    """Break a text after every ``per_line`` words; other whitespace becomes one blank."""
    line = rf"((?:[^ ]+ ){{{per_line - 1}}}[^ ]+) "
    return F.regexp_replace(plain(text), line, f"$1{separator}")


def hover(label: Column, text: Column, per_line: int = 10) -> Column:
    return F.concat(F.lit("<b>Label: "), label, F.lit("</b><br><br>"), wrapped(text, per_line))


# Names of the features that need neither a lexicon nor an annotator.
NATIVE_FEATURES = (
    "char_len", "word_len", "sentence_count", "avg_word_len", "exclamation_count", "question_count",
    "uppercase_ratio", "superlative_count", "superlative_density", "ttr", "entity_count", "entity_density",
)


def with_native_features(texts: DataFrame, text: str = "text_",
                         superlatives: Sequence[str] = SUPERLATIVES) -> DataFrame:
    """Add every native feature of a text column.

    Shared intermediate results are columns of their own, so that each pass over
    the text happens once.
    """
    content = F.col(text)
    shared = (
        texts.withColumns({"_plain": plain(content), "_lower": F.lower(content)})
        .withColumn("_letters", letter_runs(F.col("_lower")))
    )
    counted = shared.withColumns({
        "char_len": char_count(content),
        "_blanks": F.length("_plain") - F.length(F.replace("_plain", F.lit(" "), F.lit(""))),
        "sentence_count": sentence_count(content),
        "exclamation_count": count_char(content, "!"),
        "question_count": count_char(content, "?"),
        "_capitals": count_pattern(content, UPPERCASE),
        "superlative_count": count_pattern(F.col("_lower"), whole_words(superlatives)),
        "_distinct": F.size(F.array_distinct("_letters")),
        "entity_count": entity_count(content),
    }).withColumn("word_len", F.when(F.col("_plain") == "", 0).otherwise(F.col("_blanks") + 1))
    return counted.withColumns({
        "avg_word_len": F.coalesce(per_word(F.length("_plain") - F.col("_blanks"), F.col("word_len")), F.lit(0.0)),
        "uppercase_ratio": F.col("_capitals") / F.greatest("char_len", F.lit(1)),
        "superlative_density": per_word(F.col("superlative_count"), F.col("word_len")),
        "ttr": F.col("_distinct") / F.greatest(F.size("_letters"), F.lit(1)),
        "entity_density": per_word(F.col("entity_count"), F.col("word_len")),
    }).drop("_blanks", "_capitals", "_distinct", "_lower")


def without_helpers(measured: DataFrame) -> DataFrame:
    """Drop the intermediate results that ``with_native_features`` leaves for reuse."""
    return measured.drop("_plain", "_letters")
