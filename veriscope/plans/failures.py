"""Do the models fail on the same texts, and which texts are those?"""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope.operators.consolidate import (
    MARK_COLOURS, MARK_NAMES, all_wrong, any_error, attach_flags, cohort, difficulty, display_value, joint_failures,
    majority_vote,
)
from veriscope.operators.metrics import agreement, disagreement_labels, frequencies
from veriscope.operators.terms import term_frequencies
from veriscope.plans.ctes import STOP_WORDS as STOP_SQL
from veriscope.plans.ctes import sql
from veriscope.plans.tables import MODELS, STOP_WORDS, documents, labels, predictions, rounded, wide
from veriscope.shared import broadcast_if_small, settle


def model_agreement(spark, sf_dir):
    return agreement(wide(spark, sf_dir), MODELS)


def _with_text(chosen, spark, sf_dir):
    """Fetch the texts of chosen rows; the full texts are not shuffled for a small choice."""
    texts = documents(spark, sf_dir).select("id", "text_")
    return texts.join(broadcast_if_small(settle(chosen)), "id")


def all_models_wrong(spark, sf_dir):
    return _with_text(wide(spark, sf_dir).where(all_wrong(MODELS)), spark, sf_dir)


def all_wrong_by_category(spark, sf_dir):
    return frequencies(wide(spark, sf_dir).where(all_wrong(MODELS)), "category")


def hardest_50(spark, sf_dir):
    """The 50 texts most models miss, longest first."""
    scored = wide(spark, sf_dir, "wl").withColumn("difficulty", difficulty(MODELS))
    hardest = (
        scored.withColumnRenamed("wl", "word_length")
        .orderBy(F.desc("difficulty"), F.desc("word_length"), "id").limit(50)
    )
    return documents(spark, sf_dir).select("id", "text_").join(F.broadcast(hardest), "id")  # 50 rows


def joint_failure_flags(spark, sf_dir):
    return wide(spark, sf_dir).select("id", "label", *[c.alias(n) for n, c in joint_failures(MODELS).items()])


def pair_disagreement_labels(spark, sf_dir):
    return disagreement_labels(wide(spark, sf_dir), "rule_length", "rule_punct")


def pair_failures(spark, sf_dir):
    """Texts that two given models both miss."""
    both = (F.col("rule_length") == 0) & (F.col("rule_variety") == 0)
    return wide(spark, sf_dir).where(both).select("id", "label", "rule_punct")


def error_marks(spark, sf_dir):
    """Any-error flag of each text with its mark name and colour."""
    flagged = wide(spark, sf_dir).select("id", any_error(MODELS).alias("any_error"))
    return flagged.withColumns({
        "mark": display_value(F.col("any_error"), MARK_NAMES),
        "colour": display_value(F.col("any_error"), MARK_COLOURS),
    })


def term_freq_hard_cases(spark, sf_dir):
    hard = settle(wide(spark, sf_dir).where(all_wrong(MODELS)).select("id"))
    texts = documents(spark, sf_dir).join(broadcast_if_small(hard), "id", "left_semi")
    return term_frequencies(texts, 50, STOP_WORDS)


def term_freq_corpus(spark, sf_dir):
    """The 50 most frequent terms of all texts."""
    return term_frequencies(documents(spark, sf_dir), 50, STOP_WORDS)


def _gaps(spark, sf_dir):
    """Labelled texts of which one model left out some, and all models a few."""
    known = predictions(spark, sf_dir).where((F.col("id") % 35 != 0) & ((F.col("model") != "rule_variety") | (F.col("id") % 7 != 0)))
    return attach_flags(labels(spark, sf_dir), known, MODELS)


def agreement_with_gaps(spark, sf_dir):
    return agreement(_gaps(spark, sf_dir), MODELS)


def difficulty_with_gaps(spark, sf_dir):
    return _gaps(spark, sf_dir).groupBy(difficulty(MODELS).alias("difficulty")).agg(F.count("*").alias("n"))


def cohort_with_gaps(spark, sf_dir):
    return _gaps(spark, sf_dir).groupBy(cohort(MODELS).alias("cohort")).agg(F.count("*").alias("n"))


def votes_with_gaps(spark, sf_dir):
    flags = {"vote": majority_vote(MODELS), "any_error": any_error(MODELS), **joint_failures(MODELS)}
    return _gaps(spark, sf_dir).select("id", *[c.alias(n) for n, c in flags.items()])


QUERIES = {
    "agreement_with_gaps": agreement_with_gaps,
    "difficulty_with_gaps": difficulty_with_gaps,
    "cohort_with_gaps": cohort_with_gaps,
    "votes_with_gaps": votes_with_gaps,
    "model_agreement": model_agreement,
    "all_models_wrong": all_models_wrong,
    "all_wrong_by_category": all_wrong_by_category,
    "hardest_50": hardest_50,
    "joint_failure_flags": joint_failure_flags,
    "pair_disagreement_labels": pair_disagreement_labels,
    "pair_failures": pair_failures,
    "error_marks": error_marks,
    "term_freq_hard_cases": term_freq_hard_cases,
    "term_freq_corpus": term_freq_corpus,
}


def _top_terms(source: str) -> str:
    return rf"""
        SELECT term, count(*) AS freq
        FROM (SELECT unnest(regexp_extract_all(lower(text_), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM {source})
        WHERE term NOT IN ({STOP_SQL}) GROUP BY term ORDER BY freq DESC, term LIMIT 50"""


GAPS = """, gaps AS (
    SELECT id, label, CASE WHEN id % 35 <> 0 THEN rule_length END AS a, CASE WHEN id % 7 <> 0 THEN rule_variety END AS b,
           CASE WHEN id % 35 <> 0 THEN rule_punct END AS c FROM wide),
  counted AS (
    SELECT *, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS hits,
           (a IS NOT NULL)::INTEGER + (b IS NOT NULL)::INTEGER + (c IS NOT NULL)::INTEGER AS answers FROM gaps)
"""

ORACLE = {
    "agreement_with_gaps": sql(GAPS + """
        SELECT coalesce(a::VARCHAR, '-') || '-' || coalesce(b::VARCHAR, '-') || '-' || coalesce(c::VARCHAR, '-') AS pattern,
               count(*) AS count FROM counted GROUP BY pattern""", "wide"),
    "difficulty_with_gaps": sql(GAPS + """
        SELECT CASE WHEN answers > 0 THEN answers - hits END AS difficulty, count(*) AS n FROM counted GROUP BY difficulty""", "wide"),
    "cohort_with_gaps": sql(GAPS + """
        SELECT CASE WHEN label = 'OR' THEN 'genuine' WHEN answers = 0 THEN NULL WHEN answers - hits <= 1 THEN 'fake_caught'
               ELSE 'fake_escaped' END AS cohort, count(*) AS n FROM counted GROUP BY cohort""", "wide"),
    "votes_with_gaps": sql(GAPS + """
        SELECT id, CASE WHEN answers > 0 THEN CAST(2 * hits > answers AS INTEGER) END AS vote,
               CASE WHEN answers > 0 THEN CAST(hits < answers AS INTEGER) END AS any_error,
               a = 0 AND b = 0 AS rule_length__rule_variety__wrong, a = 0 AND c = 0 AS rule_length__rule_punct__wrong,
               b = 0 AND c = 0 AS rule_variety__rule_punct__wrong, answers > 0 AND hits = 0 AS all_wrong
        FROM counted""", "wide"),
    "model_agreement": sql("""
        SELECT concat_ws('-', rule_length, rule_variety, rule_punct) AS pattern, count(*) AS count
        FROM wide GROUP BY pattern""", "wide"),
    "all_models_wrong": sql("""
        SELECT w.id, w.category, w.rating, w.label, r.text_, rule_length, rule_variety, rule_punct, correct_count
        FROM wide w JOIN reviews r ON w.id = r.id
        WHERE rule_length = 0 AND rule_variety = 0 AND rule_punct = 0""", "wide"),
    "all_wrong_by_category": sql("""
        SELECT category, count(*) AS count FROM wide WHERE correct_count = 0 GROUP BY category""", "wide"),
    "hardest_50": sql("""
        SELECT w.id, w.category, w.rating, w.label, CAST(w.wl AS INTEGER) AS word_length, rule_length, rule_variety, rule_punct,
               correct_count, difficulty, r.text_
        FROM wide w JOIN reviews r ON w.id = r.id ORDER BY difficulty DESC, w.wl DESC, w.id LIMIT 50""", "wide"),
    "joint_failure_flags": sql("""
        SELECT id, label, rule_length = 0 AND rule_variety = 0 AS rule_length__rule_variety__wrong,
               rule_length = 0 AND rule_punct = 0 AS rule_length__rule_punct__wrong,
               rule_variety = 0 AND rule_punct = 0 AS rule_variety__rule_punct__wrong,
               correct_count = 0 AS all_wrong FROM wide""", "wide"),
    "pair_disagreement_labels": sql("""
        SELECT label, count(*) FILTER (WHERE rule_length = 1 AND rule_punct = 1) AS both_correct,
               count(*) FILTER (WHERE rule_length = 0 AND rule_punct = 0) AS both_wrong,
               count(*) FILTER (WHERE rule_length = 1 AND rule_punct = 0) AS only_first_correct,
               count(*) FILTER (WHERE rule_length = 0 AND rule_punct = 1) AS only_second_correct
        FROM wide GROUP BY label""", "wide"),
    "pair_failures": sql("""
        SELECT id, label, rule_punct FROM wide WHERE rule_length = 0 AND rule_variety = 0""", "wide"),
    "error_marks": sql("""
        SELECT id, CAST(correct_count < 3 AS INTEGER) AS any_error,
               CASE WHEN correct_count < 3 THEN 'At least 1 error' ELSE 'All correct' END AS mark,
               CASE WHEN correct_count < 3 THEN '#e74c3c' ELSE '#2ecc71' END AS colour FROM wide""", "wide"),
    "term_freq_hard_cases": sql(
        ", hard AS (SELECT r.text_ FROM reviews r JOIN wide w ON r.id = w.id WHERE correct_count = 0)"
        + _top_terms("hard"), "wide"),
    "term_freq_corpus": sql(_top_terms("docs"), "docs"),
}
