"""Many models' predictions to one row per text, and the flags built on that row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.functions.answers import correctness


def long_predictions(scored: DataFrame, predictions: dict[str, Column], carry: Sequence[str],
                     label: str = "label") -> DataFrame:
    """One row per (text, model) from per-row prediction columns, in a single scan."""
    items = F.array(*[
        F.struct(F.lit(model).alias("model"), predicted.alias("predicted_label"))
        for model, predicted in predictions.items()
    ])
    return (
        scored.select(*carry, F.inline(items))
        .withColumn("correct", correctness(F.col(label), F.col("predicted_label")))
    )


def union_predictions(frames: dict[str, DataFrame]) -> DataFrame:
    """Every model's own predictions in one table, matched by column name; a missing column is NULL."""
    named = [frame.withColumn("model", F.lit(model)) for model, frame in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def model_flags(models: Sequence[str], model: str = "model", correct: str = "correct") -> list[Column]:
    """Pivot expressions: the best outcome of every listed model."""
    return [F.max(F.when(F.col(model) == m, F.col(correct))).cast("int").alias(m) for m in models]


def correct_count(models: Sequence[str]) -> Column:
    total = F.lit(0)
    for m in models:
        total = total + F.coalesce(F.col(m), F.lit(0))
    return total


def _settle_missing(wide: DataFrame, models: Sequence[str], missing: str) -> DataFrame:
    """An unscored text stays NULL, or counts as wrong with ``missing='wrong'``."""
    if missing not in ("null", "wrong"):
        raise ValueError("missing must be 'null' or 'wrong'")
    if missing == "wrong":
        wide = wide.fillna(0, subset=list(models))
    return wide.withColumn("correct_count", correct_count(models))


def consolidate(predictions: DataFrame, models: Sequence[str], carry: Sequence[str],
                missing: str = "null", key: str = "id") -> DataFrame:
    """Base columns, one 0/1 column per model and ``correct_count``, one row per key.

    Distinct base rows, pivot and join in a single aggregation: one shuffle.  If the
    inputs disagree about a base row, the smallest wins (see ``base_conflicts``).
    """
    grouped = predictions.groupBy(key).agg(
        F.min(F.struct(*carry)).alias("base"), *model_flags(models)
    )
    wide = grouped.select(key, "base.*", *models)
    return _settle_missing(wide, models, missing)


def attach_flags(base: DataFrame, predictions: DataFrame, models: Sequence[str],
                 missing: str = "null", key: str = "id") -> DataFrame:
    """Like ``consolidate``, for a base table that may hold texts nobody scored."""
    flags = predictions.groupBy(key).agg(*model_flags(models))
    return _settle_missing(base.join(flags, key, "left"), models, missing)


def base_rows(predictions: DataFrame, carry: Sequence[str], key: str = "id") -> DataFrame:
    """One row of base columns per key; of differing rows the smallest."""
    return predictions.groupBy(key).agg(F.min(F.struct(*carry)).alias("base")).select(key, "base.*")


def base_conflicts(predictions: DataFrame, carry: Sequence[str], key: str = "id") -> DataFrame:
    """Keys whose base columns differ between models."""
    row = F.struct(*carry)
    return (
        predictions.groupBy(key)
        .agg(F.min(row).alias("first"), F.max(row).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select(key)
    )


def scored_count(models: Sequence[str]) -> Column:
    """How many of the models gave an answer."""
    total = F.lit(0)
    for m in models:
        total = total + F.col(m).isNotNull().cast("int")
    return total


def _if_scored(models: Sequence[str], value: Column) -> Column:
    return F.when(scored_count(models) > 0, value)


def difficulty(models: Sequence[str]) -> Column:
    """How many of the models are wrong; NULL if none gave an answer."""
    return _if_scored(models, scored_count(models) - correct_count(models))


def majority_vote(models: Sequence[str]) -> Column:
    """1 if more than half of the models that answered are right; NULL if none answered."""
    return _if_scored(models, (2 * correct_count(models) > scored_count(models)).cast("int"))


def any_error(models: Sequence[str]) -> Column:
    """1 if a model that answered is wrong; NULL if none answered."""
    return _if_scored(models, (correct_count(models) < scored_count(models)).cast("int"))


def all_wrong(models: Sequence[str]) -> Column:
    """Whether there are answers and all of them are wrong; never NULL."""
    return (scored_count(models) > 0) & (correct_count(models) == 0)


# Names of the three cohorts, and of the marks and colours in charts.
GENUINE, CAUGHT, ESCAPED = "genuine", "fake_caught", "fake_escaped"
MARK_COLOURS = {0: "#2ecc71", 1: "#e74c3c"}
MARK_NAMES = {0: "All correct", 1: "At least 1 error"}


def cohort(models: Sequence[str], label: str = "label", fake: str = "CG", real: str = "OR") -> Column:
    """Genuine text, fake that at most one model missed, or fake that more missed; NULL for a
    fake that no model judged."""
    return (
        F.when(F.col(label) == real, GENUINE)
        .when((F.col(label) == fake) & (difficulty(models) <= 1), CAUGHT)
        .when((F.col(label) == fake) & (difficulty(models) >= 2), ESCAPED)
    )


def display_value(flag: Column, names: dict[int, str]) -> Column:
    chosen = F.lit(None).cast("string")
    for code, name in names.items():
        chosen = F.when(flag == code, F.lit(name)).otherwise(chosen)
    return chosen


def joint_failures(models: Sequence[str]) -> dict[str, Column]:
    """For every pair of models, and for all of them: do they fail together?"""
    flags = {
        # NULL where one of the two gave no answer and the other is wrong
        f"{a}__{b}__wrong": ((F.col(a) == 0) & (F.col(b) == 0)) for a, b in combinations(models, 2)
    }
    flags["all_wrong"] = all_wrong(models)
    return flags
