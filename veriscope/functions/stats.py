"""Test statistics and intervals as column expressions over already aggregated rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 95 % quantiles of the standard normal and of chi-square with one degree.
Z_95 = 1.959963984540054
CHI2_95 = 3.841458820694124


def mcnemar_chi2(first_only: Column, second_only: Column) -> Column:
    """Continuity-corrected McNemar statistic; NULL when the models never disagree."""
    discordant = (first_only + second_only).cast("double")
    gap = F.abs(first_only - second_only) - 1
    return F.try_divide((gap * gap).cast("double"), discordant)


def erfc(x: Column, terms: int = 120, fractions: int = 80) -> Column:
    """Complementary error function of a number of at least 0.

    Near 0 one minus the series of erf, beyond 2 a continued fraction, which keeps small values exact.
    """
    steps = F.sequence(F.lit(1), F.lit(terms))
    start = F.struct((2 * x / math.sqrt(math.pi)).alias("term"), (2 * x / math.sqrt(math.pi)).alias("total"))
    series = F.aggregate(
        steps, start,
        lambda acc, n: F.struct((acc["term"] * x * x / (n + 0.5)).alias("term"),
                                (acc["total"] + acc["term"] * x * x / (n + 0.5)).alias("total")),
        lambda acc: acc["total"],
    )
    fraction = F.aggregate(F.sequence(F.lit(fractions), F.lit(1)), x, lambda t, k: x + k / (2 * t))
    bell = F.exp(-x * x)
    return F.when(x < 2, 1 - bell * series).otherwise(bell / (math.sqrt(math.pi) * fraction))


def chi2_p_value(chi2: Column | str) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    value = F.col(chi2) if isinstance(chi2, str) else chi2
    return F.when(value.isNotNull(), erfc(F.sqrt(value / 2)))


def wilson_bounds(successes: Column, trials: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Lower and upper Wilson bound of a proportion; NULL for zero trials."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p = successes.cast("double") / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    centre = p + z * z / (2 * n)
    scale = 1 + z * z / n
    return (
        F.when(n.isNotNull(), F.greatest((centre - spread) / scale, F.lit(0.0))),
        F.when(n.isNotNull(), F.least((centre + spread) / scale, F.lit(1.0))),
    )


def star_rating(logits: Column) -> tuple[Column, Column]:
    """(1-based class, its softmax probability) of an array of class scores."""
    top = F.array_max(logits)
    mass = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max(logits)))
    return F.array_position(logits, top).cast("int"), 1.0 / mass
