"""How often the models are right, overall and by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope.functions.answers import correctness
from veriscope.functions.bins import with_quantile_bins
from veriscope.operators.consolidate import attach_flags, base_rows, difficulty, majority_vote, union_predictions
from veriscope.operators.metrics import (
    accuracy_by, accuracy_with_interval, classification_report, classifier_summary, confusion_matrix,
    corpus_summary, difficulty_summary, mean_by, model_scores, overall_accuracy, paired_tests,
)
from veriscope.operators.selection import nested_samples, seeded_sample
from veriscope.plans.ctes import sql
from veriscope.plans.tables import BASE, LABELS, MODELS, facts, predictions, reviews, rounded, rules, wide
from veriscope.shared import settle

SAMPLE_SIZES = (50, 100, 200)
SAMPLED_IDS = 100


def combined_predictions(spark, sf_dir):
    return attach_flags(reviews(spark, sf_dir), predictions(spark, sf_dir), MODELS, missing="wrong")


def union_of_models(spark, sf_dir):
    """Each model's own table, united; only one of them carries an explanation."""
    measured = settle(facts(spark, sf_dir))
    frames = {
        model: measured.select("id", "label", rule.alias("predicted_label"))
        .withColumn("correct", correctness(F.col("label"), F.col("predicted_label")))
        for model, rule in rules().items()
    }
    frames["rule_length"] = frames["rule_length"].withColumn("explanation", F.lit("length"))
    return union_predictions(frames)


def distinct_reviews(spark, sf_dir):
    return base_rows(predictions(spark, sf_dir, "category", "rating"), BASE)


def corpus_overview(spark, sf_dir):
    return corpus_summary(wide(spark, sf_dir))


def overall(spark, sf_dir):
    return rounded(overall_accuracy(wide(spark, sf_dir), MODELS))


def model_vs_ensemble(spark, sf_dir):
    return rounded(overall_accuracy(wide(spark, sf_dir), MODELS, ensemble=True))


def ensemble_votes(spark, sf_dir):
    flagged = wide(spark, sf_dir)
    return flagged.select("id", "correct_count", majority_vote(MODELS).alias("ensemble_vote"))


def mcnemar_pairs(spark, sf_dir):
    return rounded(paired_tests(wide(spark, sf_dir), MODELS))


def mcnemar_p_values(spark, sf_dir):
    return rounded(paired_tests(wide(spark, sf_dir), MODELS, p_values=True))


def category_accuracy(spark, sf_dir):
    return rounded(accuracy_by(wide(spark, sf_dir), MODELS, "category"))


def rating_accuracy(spark, sf_dir):
    return rounded(accuracy_by(wide(spark, sf_dir), MODELS, "rating"))


def length_bin_accuracy(spark, sf_dir):
    narrow = settle(wide(spark, sf_dir, "wl").select("wl", *MODELS))
    return rounded(accuracy_by(with_quantile_bins(narrow, "wl"), MODELS, "bin_no", "bin_label"))


def difficulty_counts(spark, sf_dir):
    return difficulty_summary(wide(spark, sf_dir).select(difficulty(MODELS).alias("difficulty")))


def difficulty_by_category(spark, sf_dir):
    hard = wide(spark, sf_dir).select("category", difficulty(MODELS).alias("difficulty"))
    return rounded(mean_by(hard, "difficulty", "category"))


def confusion(spark, sf_dir):
    return confusion_matrix(predictions(spark, sf_dir), LABELS)


def report(spark, sf_dir):
    return rounded(classification_report(predictions(spark, sf_dir), LABELS))


def summary(spark, sf_dir):
    return rounded(classifier_summary(predictions(spark, sf_dir), LABELS))


def wilson_by_model(spark, sf_dir):
    return rounded(accuracy_with_interval(predictions(spark, sf_dir), "model"))


def wilson_by_sample_size(spark, sf_dir):
    chosen = nested_samples(wide(spark, sf_dir), SAMPLE_SIZES)
    scored = chosen.select("sample_size", F.col("rule_length").alias("correct"))
    return rounded(accuracy_with_interval(scored, "sample_size"))


def _sampled_ids(spark, sf_dir):
    return seeded_sample(facts(spark, sf_dir).select("id"), SAMPLED_IDS, check=False)


def semi_join_sampled_ids(spark, sf_dir):
    """Every model's predictions for the sampled texts only."""
    sampled = F.broadcast(_sampled_ids(spark, sf_dir))  # SAMPLED_IDS rows
    kept = predictions(spark, sf_dir).join(sampled, "id", "left_semi")
    return kept.select("id", "model", "label", "predicted_label", "correct")


def model_comparison_same_ids(spark, sf_dir):
    return rounded(model_scores(semi_join_sampled_ids(spark, sf_dir)))


QUERIES = {
    "combined_predictions": combined_predictions,
    "union_of_models": union_of_models,
    "distinct_reviews": distinct_reviews,
    "corpus_summary": corpus_overview,
    "overall_accuracy": overall,
    "model_vs_ensemble": model_vs_ensemble,
    "ensemble_votes": ensemble_votes,
    "mcnemar_pairs": mcnemar_pairs,
    "mcnemar_p_values": mcnemar_p_values,
    "category_accuracy": category_accuracy,
    "rating_accuracy": rating_accuracy,
    "length_bin_accuracy": length_bin_accuracy,
    "difficulty_summary": difficulty_counts,
    "difficulty_by_category": difficulty_by_category,
    "confusion_matrix": confusion,
    "classification_report": report,
    "classifier_summary": summary,
    "wilson_by_model": wilson_by_model,
    "wilson_by_sample_size": wilson_by_sample_size,
    "semi_join_sampled_ids": semi_join_sampled_ids,
    "model_comparison_same_ids": model_comparison_same_ids,
}

ACCURACY_COLUMNS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in MODELS)

def _wilson(source: str, by: str) -> str:
    return f"""
    SELECT {by}, n_valid, n_correct, round(p, 6) AS accuracy,
           round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0.0), 6) AS ci_low,
           round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1.0), 6) AS ci_high
    FROM (SELECT {by}, count(correct) AS n_valid, CAST(sum(correct) AS BIGINT) AS n_correct,
                 CAST(count(correct) AS DOUBLE) AS n, avg(correct) AS p, CAST(1.959963984540054 AS DOUBLE) AS z
          FROM {source} GROUP BY {by})"""


def _pair(a: str, b: str) -> str:
    return f"""
    SELECT '{a}' AS first, '{b}' AS second,
           count(*) FILTER (WHERE {a} = 1 AND {b} = 1) AS both_correct,
           count(*) FILTER (WHERE {a} = 1 AND {b} = 0) AS first_only,
           count(*) FILTER (WHERE {a} = 0 AND {b} = 1) AS second_only,
           count(*) FILTER (WHERE {a} = 0 AND {b} = 0) AS both_wrong
    FROM wide"""


REPORT_BODY = """
, per_class AS (
  SELECT m.model, c.class,
         CAST(count(*) FILTER (WHERE p.label = c.class AND p.predicted_label = c.class) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (WHERE p.predicted_label = c.class) AS DOUBLE) AS predicted,
         CAST(count(*) FILTER (WHERE p.label = c.class) AS DOUBLE) AS support
  FROM (SELECT DISTINCT model FROM predictions) m CROSS JOIN (VALUES ('CG'), ('OR')) c(class)
  JOIN predictions p ON p.model = m.model GROUP BY ALL),
rates AS (
  SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
         coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM per_class),
report AS (
  SELECT model, class, precision, recall, f1, support FROM rates
  UNION ALL
  SELECT model, 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support)
  FROM rates GROUP BY model
  UNION ALL
  SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rates GROUP BY model
  UNION ALL
  SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), sum(support) FROM rates GROUP BY model)
"""

SAMPLED = f"""
, sampled AS (
  SELECT id FROM reviews ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id LIMIT {SAMPLED_IDS})
"""

ORACLE = {
    "combined_predictions": sql("""
        SELECT w.id, w.category, w.rating, w.label, r.text_, rule_length, rule_variety, rule_punct, correct_count
        FROM wide w JOIN reviews r ON w.id = r.id""", "wide"),
    "union_of_models": sql("""
        SELECT id, label, model, predicted_label, correct,
               CASE WHEN model = 'rule_length' THEN 'length' END AS explanation FROM predictions""", "predictions"),
    "distinct_reviews": sql("SELECT DISTINCT id, category, rating, label FROM predictions", "predictions"),
    "corpus_summary": sql("SELECT count(*) AS n_rows, count(DISTINCT category) AS n_groups FROM wide", "wide"),
    "overall_accuracy": sql("""
        SELECT model, round(avg(correct), 6) AS accuracy FROM predictions GROUP BY model""", "predictions"),
    "model_vs_ensemble": sql("""
        SELECT model, round(avg(correct), 6) AS accuracy FROM predictions GROUP BY model
        UNION ALL
        SELECT 'ensemble', round(avg(CASE WHEN correct_count >= 2 THEN 1 ELSE 0 END), 6) FROM wide""", "wide"),
    "ensemble_votes": sql("""
        SELECT id, correct_count, CAST(correct_count >= 2 AS INTEGER) AS ensemble_vote FROM wide""", "wide"),
    "mcnemar_pairs": sql(f"""
        SELECT * EXCLUDE (chi), round(chi, 6) AS chi2, coalesce(chi > 3.841458820694124, false) AS significant
        FROM (SELECT *, CASE WHEN first_only + second_only > 0 THEN
                     CAST((abs(first_only - second_only) - 1) ** 2 AS DOUBLE) / (first_only + second_only) END AS chi
              FROM ({_pair("rule_length", "rule_variety")} UNION ALL {_pair("rule_length", "rule_punct")}
                    UNION ALL {_pair("rule_variety", "rule_punct")}))""", "wide"),
    "mcnemar_p_values": sql(f"""
        , tested AS (
          SELECT *, CASE WHEN first_only + second_only > 0 THEN
                   CAST((abs(first_only - second_only) - 1) ** 2 AS DOUBLE) / (first_only + second_only) END AS chi
          FROM ({_pair("rule_length", "rule_variety")} UNION ALL {_pair("rule_length", "rule_punct")}
                UNION ALL {_pair("rule_variety", "rule_punct")})),
        roots AS (SELECT *, sqrt(chi / 2) AS x FROM tested)
        SELECT * EXCLUDE (chi, x), round(chi, 6) AS chi2, coalesce(chi > 3.841458820694124, false) AS significant,
               CASE WHEN x = 0 THEN 1.0 WHEN x > 6 THEN 0.0
                    ELSE round(1 - exp(-x * x) * list_sum(list_transform(range(200), lambda n:
                         exp((2 * n + 1) * ln(x) - lgamma(n + 1.5)))), 6) END AS p_value
        FROM roots""", "wide"),
    "category_accuracy": sql(f"SELECT category, count(*) AS n, {ACCURACY_COLUMNS} FROM wide GROUP BY category", "wide"),
    "rating_accuracy": sql(f"SELECT rating, count(*) AS n, {ACCURACY_COLUMNS} FROM wide GROUP BY rating", "wide"),
    "length_bin_accuracy": sql(f"""
        , cuts AS (
          SELECT list_sort(list_distinct(list_transform(
                   quantile_cont(wl, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda q: round(CAST(q AS DOUBLE), 9)))) AS e FROM wide),
        binned AS (
          SELECT w.*, e, greatest(1, least(greatest(len(e) - 1, 1), len(list_filter(e, lambda q: q < wl)))) AS b
          FROM wide w, cuts),
        named AS (
          SELECT *, CASE WHEN b = 1 THEN floor(e[1] - 0.001) ELSE floor(e[b]) END + 1 AS lo,
                 floor(e[least(b + 1, len(e))]) AS hi FROM binned)
        SELECT CAST(b AS INTEGER) AS bin_no,
               CAST(lo AS BIGINT) || '–' || CAST(hi AS BIGINT) || ' Wörter' AS bin_label,
               count(*) AS n, {ACCURACY_COLUMNS}
        FROM named GROUP BY ALL""", "wide"),
    "difficulty_summary": sql("""
        SELECT difficulty, count(*) AS count,
               CAST(round(count(*) * 100.0 / (SELECT count(*) FROM wide), 1) AS DOUBLE)::VARCHAR || '%' AS pct
        FROM wide GROUP BY difficulty""", "wide"),
    "difficulty_by_category": sql("""
        SELECT category, round(avg(difficulty), 6) AS mean_difficulty FROM wide GROUP BY category""", "wide"),
    "confusion_matrix": sql("""
        SELECT m.model, c.label, count(*) FILTER (WHERE p.label = c.label AND predicted_label = 'CG') AS predicted_CG,
               count(*) FILTER (WHERE p.label = c.label AND predicted_label = 'OR') AS predicted_OR
        FROM (SELECT DISTINCT model FROM predictions) m CROSS JOIN (VALUES ('CG'), ('OR')) c(label)
        JOIN predictions p ON p.model = m.model GROUP BY m.model, c.label""", "predictions"),
    "classification_report": sql(REPORT_BODY + """
        SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
               CAST(support AS BIGINT) AS support FROM report""", "predictions"),
    "classifier_summary": sql(REPORT_BODY + """
        SELECT model, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
               round(recall, 6) AS accuracy, CAST(support AS BIGINT) AS support
        FROM report WHERE class = 'weighted avg'""", "predictions"),
    "wilson_by_model": sql(_wilson("predictions", "model"), "predictions"),
    "wilson_by_sample_size": sql("""
        , ranked AS (
          SELECT rule_length AS correct, row_number() OVER (ORDER BY md5(concat('42:', CAST(id AS VARCHAR))), id) AS r
          FROM wide),
        samples AS (
          SELECT n AS sample_size, correct FROM ranked JOIN (VALUES (50), (100), (200)) s(n) ON r <= n)"""
        + _wilson("samples", "sample_size"), "wide"),
    "semi_join_sampled_ids": sql(SAMPLED + """
        SELECT id, model, label, predicted_label, correct FROM predictions
        WHERE id IN (SELECT id FROM sampled)""", "predictions"),
    "model_comparison_same_ids": sql(SAMPLED + """
        SELECT model, CAST(sum(correct) AS BIGINT) AS n_correct, CAST(sum(1 - correct) AS BIGINT) AS n_wrong,
               count(*) AS total, round(avg(correct), 6) AS accuracy
        FROM predictions WHERE id IN (SELECT id FROM sampled) GROUP BY model""", "predictions"),
}
