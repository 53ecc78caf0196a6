"""How measured features relate to difficulty and to cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriscope.operators.quantiles import exact_quantiles


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over the pairs without NULL; NULL for a constant column.

    ``corr`` itself raises a division by zero for a constant column in ANSI mode.
    """
    x, y = x.cast("double"), y.cast("double")
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, features: Sequence[str], target: str = "difficulty") -> DataFrame:
    """Mean of every feature and its Pearson correlation with the target, in one pass."""
    measured = df.agg(
        *[F.avg(f).cast("double").alias(f"mean_{f}") for f in features],
        *[pearson(F.col(f), F.col(target)).alias(f"corr_{f}") for f in features],
    )
    return measured.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"mean_{f}").alias("mean"),
                 F.col(f"corr_{f}").alias(f"corr_with_{target}"))
        for f in features
    ])))


def describe_by(df: DataFrame, measure: str, by: str = "difficulty") -> DataFrame:
    """Count, mean and exact median of a measure per group; NULL measures are skipped.

    ``df`` is read three times: settle it first when it is expensive.
    """
    basics = df.groupBy(by).agg(F.count(measure).alias("count"), F.avg(measure).alias("mean"))
    medians = exact_quantiles(df, measure, [0.5], [by]).select(
        F.col(by).alias("group"), F.col("quantile").alias("median")
    )
    return (
        basics.join(medians, basics[by].eqNullSafe(medians["group"]), "left")
        .select(by, "count", "mean", "median")
        .orderBy(by)
    )


def cohort_summary(df: DataFrame, cohort: str = "cohort", label: str = "label") -> DataFrame:
    """Rows per cohort, with the percentage of all rows and of the cohort's own label."""
    counts = df.where(F.col(cohort).isNotNull()).groupBy(label, cohort).agg(F.count("*").alias("count"))
    every = F.sum("count").over(Window.partitionBy(F.lit(1)))  # over a handful of counted rows
    same_label = F.sum("count").over(Window.partitionBy(label))
    return counts.select(
        label, cohort, "count",
        (F.col("count") * 100 / every).alias("pct_of_all"),
        (F.col("count") * 100 / same_label).alias("pct_of_label"),
    )


def profile_long(df: DataFrame, features: Sequence[str], cohort: str = "cohort") -> DataFrame:
    """Mean of every feature per cohort: rows (cohort, feature, mean)."""
    means = df.where(F.col(cohort).isNotNull()).groupBy(cohort).agg(
        *[F.avg(f).cast("double").alias(f) for f in features]
    )
    return means.unpivot([cohort], list(features), "feature", "mean")


def profile(df: DataFrame, features: Sequence[str], cohorts: Sequence[str], cohort: str = "cohort",
            digits: int = 2) -> DataFrame:
    """Side by side: one row per feature, one rounded mean per cohort."""
    return (
        profile_long(df, features, cohort)
        .groupBy("feature")
        .agg(*[F.round(F.max(F.when(F.col(cohort) == c, F.col("mean"))), digits).alias(c) for c in cohorts])
    )


def profile_z(df: DataFrame, features: Sequence[str], cohort: str = "cohort") -> DataFrame:
    """Deviation of each cohort's mean from the mean of cohorts, in sample standard deviations."""
    same_feature = Window.partitionBy("feature")  # one row per cohort
    spread = F.stddev_samp("mean").over(same_feature) + 1e-9
    return profile_long(df, features, cohort).withColumn(
        "z", (F.col("mean") - F.avg("mean").over(same_feature)) / spread
    )


def mean_by_cohort(df: DataFrame, measure: str, by: str = "rating", cohort: str = "cohort") -> DataFrame:
    return (
        df.where(F.col(cohort).isNotNull()).groupBy(cohort, by)
        .agg(F.avg(measure).alias(f"mean_{measure}"), F.count(measure).alias("n"))
    )
