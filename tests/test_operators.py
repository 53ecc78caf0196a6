"""Consolidation, reports and cohorts on small hand-made tables."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veriscope.functions.answers import answer_error, correctness, parsed_label, with_examples
from veriscope.functions.stats import mcnemar_chi2, star_rating
from veriscope.operators.consolidate import (
    all_wrong, any_error, attach_flags, base_conflicts, cohort, consolidate, difficulty, joint_failures, majority_vote,
)
from veriscope.operators.metrics import (
    accuracy_with_interval, best_epoch, classification_report, confusion_matrix, disagreement_labels, fold_summary,
    model_scores, overall_accuracy, paired_tests,
)
from veriscope.operators.profiles import cohort_summary, correlations, describe_by, profile, profile_z

MODELS = ("a", "b", "c")
PREDICTIONS = [
    (1, "OR", "a", "OR", 1), (1, "OR", "b", "OR", 1), (1, "OR", "c", "CG", 0),
    (2, "CG", "a", "OR", 0), (2, "CG", "b", "OR", 0), (2, "CG", "c", "OR", 0),
    (3, "CG", "a", "CG", 1), (3, "CG", "b", "CG", 1),
    (4, "OR", "a", None, None),
]


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame(PREDICTIONS, "id long, label string, model string, predicted_label string, correct int")


def test_consolidation_keeps_unscored_as_null(predictions):
    wide = consolidate(predictions, MODELS, ["label"])
    assert rows(wide, "id") == [
        (1, "OR", 1, 1, 0, 2), (2, "CG", 0, 0, 0, 0), (3, "CG", 1, 1, None, 2), (4, "OR", None, None, None, 0)]
    wrong = consolidate(predictions, MODELS, ["label"], missing="wrong")
    assert rows(wrong.where("id = 4").select(*MODELS)) == [(0, 0, 0)]
    with pytest.raises(ValueError):
        consolidate(predictions, MODELS, ["label"], missing="maybe")


def test_base_rows_without_predictions_survive(spark, predictions):
    base = spark.createDataFrame([(1, "x"), (9, "y")], "id long, category string")
    wide = attach_flags(base, predictions, MODELS)
    assert rows(wide, "id") == [(1, "x", 1, 1, 0, 2), (9, "y", None, None, None, 0)]


def test_conflicting_base_rows_are_found(spark):
    df = spark.createDataFrame(
        [(1, "t", "a", 1), (1, "other", "b", 0), (2, "t", "a", 1)], "id long, text_ string, model string, correct int")
    assert rows(base_conflicts(df, ["text_"])) == [(1,)]
    assert rows(consolidate(df, ["a", "b"], ["text_"]), "id") == [(1, "other", 1, 0, 1), (2, "t", 1, None, 1)]


def test_flags(predictions):
    wide = consolidate(predictions, MODELS, ["label"], missing="wrong")
    found = wide.select(
        "id", difficulty(MODELS), majority_vote(MODELS), any_error(MODELS), all_wrong(MODELS), cohort(MODELS),
        *joint_failures(MODELS).values())
    assert rows(found, "id") == [
        (1, 1, 1, 1, False, "genuine", False, False, False, False),
        (2, 3, 0, 1, True, "fake_escaped", True, True, True, True),
        (3, 1, 1, 1, False, "fake_caught", False, False, False, False),
        (4, 3, 0, 1, True, "genuine", True, True, True, True),
    ]


def test_unscored_texts_do_not_lower_accuracy(predictions):
    found = dict(rows(overall_accuracy(consolidate(predictions, MODELS, ["label"]), MODELS)))
    assert found == pytest.approx({"a": 2 / 3, "b": 2 / 3, "c": 0.0})
    scores = {r.model: tuple(r)[1:] for r in model_scores(predictions).collect()}
    assert scores["a"] == (2, 1, 3, pytest.approx(2 / 3)) and scores["c"] == (0, 2, 2, 0.0)


def test_reports_fill_absent_classes(predictions):
    matrix = {tuple(r)[:2]: tuple(r)[2:] for r in confusion_matrix(predictions, ["CG", "OR", "ZZ"]).collect()}
    assert matrix["a", "CG"] == (1, 1, 0) and matrix["a", "ZZ"] == (0, 0, 0)
    report = {tuple(r)[:2]: tuple(r)[2:] for r in classification_report(predictions, ["CG", "OR"]).collect()}
    assert report["a", "CG"] == (1.0, 0.5, pytest.approx(2 / 3), 2)
    assert report["a", "accuracy"][0] == pytest.approx(2 / 3)
    assert report["c", "CG"] == (0.0, 0.0, 0.0, 1)
    assert report["a", "macro avg"][0] == pytest.approx(0.75)
    assert report["a", "weighted avg"][1] == pytest.approx(2 / 3)


def test_models_that_agree_are_not_tested(spark):
    same = spark.createDataFrame([(1, 1), (0, 0)], "a int, b int")
    row = paired_tests(same, ["a", "b"], p_values=True).first()
    assert (row.chi2, row.p_value, row.significant) == (None, None, False)
    chi2 = spark.range(1).select(mcnemar_chi2(F.lit(640), F.lit(499))).first()[0]
    assert chi2 == pytest.approx(17.208077, abs=1e-6)


def test_intervals_skip_missing_answers(predictions):
    found = {r.model: r for r in accuracy_with_interval(predictions, "model").collect()}
    assert found["a"].n_valid == 3 and 0 <= found["a"].ci_low < found["a"].accuracy < found["a"].ci_high <= 1
    unanswered = predictions.where("id = 4")
    assert tuple(accuracy_with_interval(unanswered, "model").first()) == ("a", 0, 0, None, None, None)


def test_disagreement_labels(predictions):
    wide = consolidate(predictions, MODELS, ["label"])
    assert rows(disagreement_labels(wide, "a", "c"), "label") == [("CG", 0, 1, 0, 0), ("OR", 0, 0, 1, 0)]


def test_profiles(spark):
    df = spark.createDataFrame(
        [("genuine", "OR", 0, 1.0, 5.0), ("genuine", "OR", 1, 3.0, 5.0), ("fake_caught", "CG", 1, None, 5.0),
         ("fake_escaped", "CG", 3, 9.0, 5.0)], "cohort string, label string, difficulty int, x double, flat double")
    side = {r.feature: r for r in profile(df, ["x", "flat"], ["genuine", "fake_caught", "fake_escaped"]).collect()}
    assert side["x"].genuine == 2.0 and side["x"].fake_caught is None and side["flat"].fake_escaped == 5.0
    z = {(r.cohort, r.feature): r.z for r in profile_z(df, ["flat"]).collect()}
    assert set(z.values()) == {0.0}
    summary = {r.cohort: r for r in cohort_summary(df).collect()}
    assert summary["genuine"].pct_of_all == 50.0 and summary["fake_escaped"].pct_of_label == 50.0
    corr = {r.feature: r.corr_with_difficulty for r in correlations(df, ["x", "flat"]).collect()}
    assert corr["x"] == pytest.approx(0.9958706) and corr["flat"] is None
    described = rows(describe_by(df, "x"), "difficulty")
    assert described == [(0, 1, 1.0, 1.0), (1, 1, 3.0, 3.0), (3, 1, 9.0, 9.0)]


def test_folds_and_history(spark):
    scores = spark.createDataFrame([(10, 1.0, 0.5), (10, 0.8, 0.7)], "train_size long, train_score double, val_score double")
    assert tuple(fold_summary(scores).first()) == pytest.approx((10, 0.9, 0.6, 0.1, 0.1))
    history = spark.createDataFrame([("m", 0.5, 0.7), ("m", 0.4, 0.6)], "model string, val_loss double, val_accuracy double")
    assert tuple(best_epoch(history).first()) == ("m", 0.4, 0.7)


def test_answers(spark):
    given = ['{"label":"CG"}', '{"label":"OR","explanation":"x"}', '{"label":"XX"}', "not json", '{"other":1}', '["CG"]', None, "null"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(given)], "id int, answer string")
    found = df.select("id", parsed_label(F.col("answer")), answer_error(F.col("answer")))
    assert rows(found, "id") == [
        (0, "CG", None), (1, "OR", None), (2, None, "invalid label"), (3, None, "not a JSON object"),
        (4, None, "no label"), (5, None, "not a JSON object"), (6, None, "no answer"), (7, None, "not a JSON object")]
    judged = df.select(correctness(F.lit("CG"), parsed_label(F.col("answer")))).collect()
    assert [r[0] for r in judged] == [1, 0, None, None, None, None, None, None]
    prompt = spark.range(1).select(with_examples(F.lit("A\nClassification rules:\nB"), F.lit("EX"))).first()[0]
    assert prompt.index("EX") < prompt.index("Classification rules:") < prompt.index("B")


def test_star_rating(spark):
    stars, confidence = star_rating(F.array(*[F.lit(x) for x in (0.0, 2.0, 1.0, 0.0, 0.0)]))
    row = spark.range(1).select(stars, confidence).first()
    assert row[0] == 2 and row[1] == pytest.approx(0.5637343, abs=1e-6)  # e² / (e² + e + 3)
