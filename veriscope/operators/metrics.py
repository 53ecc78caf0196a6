"""Accuracy, contingency and classification reports, each in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriscope.functions.stats import CHI2_95, chi2_p_value, mcnemar_chi2, wilson_bounds
from veriscope.operators.consolidate import majority_vote


def corpus_summary(df: DataFrame, group: str = "category") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(group).alias("n_groups"))


def overall_accuracy(wide: DataFrame, models: Sequence[str], ensemble: bool = False) -> DataFrame:
    """Accuracy per model (and of the majority vote), best first."""
    named = {m: F.col(m) for m in models}
    if ensemble:
        named["ensemble"] = majority_vote(models)
    means = wide.agg(*[F.avg(c).alias(name) for name, c in named.items()])
    return means.unpivot([], list(named), "model", "accuracy").orderBy(F.desc("accuracy"), "model")


def accuracy_by(wide: DataFrame, models: Sequence[str], *by: str) -> DataFrame:
    """Row count and accuracy of every model in each group."""
    return (
        wide.groupBy(*by)
        .agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in models])
        .orderBy(*by)
    )


def frequencies(df: DataFrame, *by: str) -> DataFrame:
    """Rows per group, most frequent first."""
    return df.groupBy(*by).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *by)


def shares(df: DataFrame, by: str, within: Sequence[str] = ()) -> DataFrame:
    """Count and share of each value, the share within ``within`` groups."""
    counts = df.groupBy(*within, by).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*within))  # over counts, not rows
    return counts.withColumn("share", F.col("count") / total)


def agreement(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """How often each pattern of right (1), wrong (0) and silent (-) models occurs."""
    pattern = F.concat_ws("-", *[F.coalesce(F.col(m).cast("string"), F.lit("-")) for m in models])
    return frequencies(wide.select(pattern.alias("pattern")), "pattern")


def paired_tests(wide: DataFrame, models: Sequence[str], p_values: bool = False) -> DataFrame:
    """Contingency and McNemar test of every model pair, counted in one pass."""
    pairs = list(combinations(models, 2))
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x in (1, 0):
            for y in (1, 0):
                cells.append(F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(f"c{i}_{x}{y}"))
    counted = wide.agg(*cells).select(F.inline(F.array(*[
        F.struct(
            F.lit(a).alias("first"), F.lit(b).alias("second"),
            F.col(f"c{i}_11").alias("both_correct"), F.col(f"c{i}_10").alias("first_only"),
            F.col(f"c{i}_01").alias("second_only"), F.col(f"c{i}_00").alias("both_wrong"),
        )
        for i, (a, b) in enumerate(pairs)
    ])))
    tested = counted.withColumn("chi2", mcnemar_chi2(F.col("first_only"), F.col("second_only")))
    tested = tested.withColumn("significant", F.coalesce(F.col("chi2") > CHI2_95, F.lit(False)))
    return tested.withColumn("p_value", chi2_p_value("chi2")) if p_values else tested


def model_scores(predictions: DataFrame) -> DataFrame:
    """Right, wrong, total and accuracy of each model; texts without prediction are left out."""
    return (
        predictions.where("correct IS NOT NULL")
        .groupBy("model")
        .agg(
            F.sum("correct").alias("n_correct"),
            F.sum(1 - F.col("correct")).alias("n_wrong"),
            F.count("*").alias("total"),
            F.avg("correct").alias("accuracy"),
        )
    )


def _label_counts(predictions: DataFrame, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per group with a count for every (label, predicted label)."""
    cells = [
        F.count_if((F.col("label") == t) & (F.col("predicted_label") == p)).alias(f"n_{i}_{j}")
        for i, t in enumerate(labels) for j, p in enumerate(labels)
    ]
    return predictions.groupBy(*by).agg(*cells)


def confusion_matrix(predictions: DataFrame, labels: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """Zero-filled matrix with a row per true label, also for labels that never occur."""
    rows = F.array(*[
        F.struct(
            F.lit(t).alias("label"),
            *[F.col(f"n_{i}_{j}").alias(f"predicted_{p}") for j, p in enumerate(labels)],
        )
        for i, t in enumerate(labels)
    ])
    return _label_counts(predictions, labels, by).select(*by, F.inline(rows))


def classification_report(predictions: DataFrame, labels: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """Precision, recall, F1 and support per label, plus accuracy, macro and weighted rows.

    Rows whose label or prediction is not among ``labels`` are left out; 0/0 counts as 0.
    """
    k = range(len(labels))

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    counts = _label_counts(predictions, labels, by)
    total = sum((F.col(f"n_{i}_{j}") for i in k for j in k), F.lit(0))
    hits = sum((F.col(f"n_{i}_{i}") for i in k), F.lit(0))
    measures = []
    for i in k:
        support = sum((F.col(f"n_{i}_{j}") for j in k), F.lit(0))
        predicted = sum((F.col(f"n_{j}_{i}") for j in k), F.lit(0))
        hit = F.col(f"n_{i}_{i}")
        measures.append((ratio(hit, predicted), ratio(hit, support), ratio(2 * hit, predicted + support), support))

    def row(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.cast("long").alias("support"),
        )

    def macro(part):
        return sum((m[part] for m in measures), F.lit(0.0)) / len(labels)

    def weighted(part):
        return ratio(sum((m[part] * m[3] for m in measures), F.lit(0.0)), total)

    accuracy = ratio(hits, total)
    rows = [row(label, *m) for label, m in zip(labels, measures)]
    rows.append(row("accuracy", accuracy, accuracy, accuracy, total))
    rows.append(row("macro avg", macro(0), macro(1), macro(2), total))
    rows.append(row("weighted avg", weighted(0), weighted(1), weighted(2), total))
    return counts.select(*by, F.inline(F.array(*rows)))


def classifier_summary(predictions: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One line per model: weighted precision, recall and F1, and accuracy."""
    report = classification_report(predictions, labels)
    return (
        report.where(F.col("class") == "weighted avg")
        .select("model", "precision", "recall", "f1", F.col("recall").alias("accuracy"), "support")
        .orderBy(F.desc("accuracy"), "model")
    )


def accuracy_with_interval(predictions: DataFrame, *by: str) -> DataFrame:
    """Accuracy and its 95 % Wilson interval; groups without a prediction keep NULL."""
    counted = predictions.groupBy(*by).agg(
        F.count("correct").alias("n_valid"), F.coalesce(F.sum("correct"), F.lit(0)).alias("n_correct")
    )
    low, high = wilson_bounds(F.col("n_correct"), F.col("n_valid"))
    accuracy = F.try_divide(F.col("n_correct").cast("double"), F.col("n_valid").cast("double"))
    return counted.select(*by, "n_valid", "n_correct", accuracy.alias("accuracy"),
                          low.alias("ci_low"), high.alias("ci_high"))


def disagreement_labels(wide: DataFrame, first: str, second: str, label: str = "label") -> DataFrame:
    """Label counts where both, only the first, or only the second model is right."""
    a, b = F.col(first) == 1, F.col(second) == 1
    return (
        wide.where(F.col(first).isNotNull() & F.col(second).isNotNull())
        .groupBy(label)
        .agg(
            F.count_if(a & b).alias("both_correct"),
            F.count_if(~a & ~b).alias("both_wrong"),
            F.count_if(a & ~b).alias("only_first_correct"),
            F.count_if(~a & b).alias("only_second_correct"),
        )
    )


def difficulty_summary(scored: DataFrame) -> DataFrame:
    """Rows and percentage per difficulty; expects a ``difficulty`` column."""
    percent = F.round(F.col("share") * 100, 1)
    return (
        shares(scored, "difficulty")
        .select("difficulty", "count", F.concat(percent.cast("string"), F.lit("%")).alias("pct"))
        .orderBy("difficulty")
    )


def mean_by(df: DataFrame, measure: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(measure).alias(f"mean_{measure}")).orderBy(F.desc(f"mean_{measure}"), *by)


def rate_by(df: DataFrame, flag: str, *by: str) -> DataFrame:
    """Share of set flags and row count per group."""
    return df.groupBy(*by).agg(F.avg(flag).alias("rate"), F.count(flag).alias("n"))


def best_epoch(history: DataFrame) -> DataFrame:
    """Lowest validation loss and highest validation accuracy of training histories."""
    return history.groupBy("model").agg(
        F.min("val_loss").alias("min_val_loss"), F.max("val_accuracy").alias("max_val_accuracy")
    )


def fold_summary(scores: DataFrame, by: str = "train_size", measures: Sequence[str] = ("train_score", "val_score")) -> DataFrame:
    """Mean and population standard deviation across folds."""
    return scores.groupBy(by).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in measures],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in measures],
    ).orderBy(by)
