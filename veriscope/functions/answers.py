"""Prompts for, and answers of, a remote text scorer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the line of a prompt template before which examples are inserted.
RULES_HEADING = "Classification rules:"


def review_prompt(category: Column, rating: Column, text: Column) -> Column:
    return F.concat(
        F.lit("\nCategory: "), category, F.lit("\nRating: "), rating.cast("string"),
        F.lit("\nReview: "), F.coalesce(text, F.lit("")), F.lit("\n"),
    )


def parsed_label(answer: Column, allowed: Sequence[str] = ("CG", "OR")) -> Column:
    """The answer's label, or NULL for anything but a JSON object with an allowed label."""
    label = F.from_json(answer, "label STRING").getField("label")
    return F.when(label.isin(list(allowed)), label)


def answer_error(answer: Column, allowed: Sequence[str] = ("CG", "OR")) -> Column:
    """Why an answer was refused; NULL for a good one."""
    label = F.from_json(answer, "label STRING").getField("label")
    return (
        F.when(answer.isNull(), "no answer")
        .when(~F.ltrim(answer).startswith("{") | F.get_json_object(answer, "$").isNull(), "not a JSON object")
        .when(label.isNull(), "no label")
        .when(~label.isin(list(allowed)), "invalid label")
    )


def answer_field(answer: Column, field: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(answer, f"$.{field}"), F.lit(default))


def cleaned_label(label: Column, allowed: Sequence[str] = ("CG", "OR")) -> Column:
    """Trimmed label if allowed, else NULL."""
    trimmed = F.trim(label.cast("string"))
    return F.when(trimmed.isin(list(allowed)), trimmed)


def correctness(label: Column, predicted: Column) -> Column:
    """1 right, 0 wrong, NULL without a prediction."""
    return F.when(predicted.isNotNull(), label.eqNullSafe(predicted).cast("int"))


# The wording of the two functions below is a fixed value: a scorer reads it.


def mistake_example(number: Column, category: Column, rating: Column, text: Column,
                    label: Column, predicted: Column) -> Column:
    """One numbered example block that shows a scorer an earlier mistake."""
    return F.concat(
        F.lit("\n"), number.cast("string"), F.lit(". Previous mistake: this review should be classified as "),
        label, F.lit(".\nExample:\nCategory: "), category, F.lit("\nRating: "), rating.cast("string"),
        F.lit("\nReview: "), text, F.lit("\nLabel: "), label,
        F.lit("\nReason: The previous prediction was "), predicted,
        F.lit(", but the correct label is "), label, F.lit(".\n"),
    )


def with_examples(template: Column, examples: Column) -> Column:
    """Insert the example block before the rules of a prompt template."""
    block = F.concat(
        F.lit("\nAdditional examples from previous model mistakes:\n"), examples,
        F.lit(f"\n\n{RULES_HEADING}\n"),
    )
    return F.replace(template, F.lit(RULES_HEADING), block)
