"""Classifiers and supplied models."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from veriscope.learning.classifiers import fit_classifier, fit_features, random_forest, score, text_and_rating, tfidf_stages
from veriscope.learning.evaluation import BOOSTED_SPACE, draw, learning_curve, named_importances, random_search
from veriscope.learning.remote import score_remotely
from veriscope.learning.vectors import (
    annotate, encode, fit_projection, hashed_word_vectors, project,
)
from veriscope.operators.terms import tfidf
from veriscope.sources.store import load_model, save_model


@pytest.fixture(scope="module")
def texts(spark):
    def line(i):
        words = "great lovely perfect" if i % 2 else "plain sturdy shelf"
        return (i, "c", float(1 + i % 5), "CG" if i % 2 else "OR", f"{words} number{i % 7} with words")

    return spark.createDataFrame([line(i) for i in range(120)], "id long, category string, rating double, label string, text_ string")


def test_pipeline_weights_equal_the_long_table(spark, texts):
    prepared, _ = fit_features(texts, tfidf_stages(vocabulary=12) + text_and_rating(12)[-1:])
    vectors = prepared.transform(texts).select("id", F.posexplode(vector_to_array("tfidf")).alias("i", "w")).where("w > 0")
    stage = next(s for s in prepared.stages if hasattr(s, "stages"))
    names = next(s for s in stage.stages if hasattr(s, "vocabulary")).vocabulary
    found = {(r.id, names[r.i]): r.w for r in vectors.collect()}
    expected = {(r.id, r.term): r.tfidf for r in tfidf(texts, 12).collect()}
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k]) for k in found)


def test_fit_score_save(spark, texts, tmp_path):
    fitted = fit_classifier(texts, text_and_rating(30), random_forest(trees=5, depth=4))
    scored = score(fitted.model, texts, "forest")
    assert scored.agg(F.avg("correct")).first()[0] > 0.95
    top = named_importances(fitted.model, top=5).collect()
    assert top[0].importance >= top[-1].importance > 0
    save_model(fitted.model, str(tmp_path / "model"))
    again = score(load_model(str(tmp_path / "model")), texts.drop("label").withColumn("label", F.lit("OR")), "forest")
    assert scored.select("id", "predicted_label").exceptAll(again.select("id", "predicted_label")).count() == 0


def test_learning_curve_and_search(spark, texts):
    curve = learning_curve(texts, lambda: text_and_rating(20), lambda: random_forest(trees=3, depth=3), (0.5, 1.0), 2)
    found = curve.collect()
    assert len(found) == 4 and all(0 <= r.val_score <= 1 for r in found)
    sizes = {r.fold: [] for r in found}
    for r in sorted(found, key=lambda r: r.fraction):
        sizes[r.fold].append(r.train_size)
    assert all(a < b for a, b in sizes.values())
    trials = random_search(texts, text_and_rating(20), random_forest, {"trees": ("int", 2, 4), "depth": [2, 3]}, trials=3)
    accuracies = [r.accuracy for r in trials.collect()]
    assert accuracies == sorted(accuracies, reverse=True) and len(accuracies) == 3


def test_drawn_parameters_stay_in_range():
    rng = random.Random(3)
    for _ in range(100):
        point = draw(BOOSTED_SPACE, rng)
        assert 3 <= point["depth"] <= 10 and 0.01 <= point["step"] <= 0.3 and 0.5 <= point["sample"] <= 1.0


def test_projection_is_centred_principal_components(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(60, 5)) * [5, 3, 1, 1, 1] + 10
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "id long, embedding array<float>")
    placed = project(fit_projection(df, 2), df).orderBy("id").select("components").collect()
    found = np.array([r.components for r in placed])
    centred = data - data.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    expected = centred @ axes[:2].T
    assert np.allclose(np.abs(found), np.abs(expected), atol=1e-3)
    assert np.allclose(found.mean(axis=0), 0, atol=1e-4)


def test_hashed_word_vectors(spark):
    df = spark.createDataFrame([(1, "Ab cd ab"), (2, "ab"), (3, "cd"), (4, None), (5, "x !"), (6, "ab ab ab")], "id long, text_ string")
    got = {r.id: r.embedding for r in hashed_word_vectors(df, size=16).collect()}
    assert all(sorted(map(abs, got[i]))[-2:] == [0.0, 1.0] for i in (2, 3))
    assert got[1] == pytest.approx([(2 * a + b) / 3 for a, b in zip(got[2], got[3])])
    assert got[4] is None and got[5] is None and got[6] == got[2]


def test_supplied_models(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text_ string")

    def make_encoder():
        return lambda batch: np.array([[len(t), 1.0] for t in batch], dtype="float32")

    assert {r.id: r.embedding for r in encode(df, make_encoder).collect()} == {1: [2.0, 1.0], 2: [0.0, 1.0]}

    def make_annotator():
        return lambda text: {"size": len(text)}

    assert dict(annotate(df, make_annotator, ["size"]).collect()) == {1: 2.0, 2: 0.0}


def test_remote_scorer_retries_and_reports(spark):
    df = spark.createDataFrame(
        [(1, "c", 5.0, "good"), (2, "c", 5.0, "broken"), (3, "c", 5.0, "flaky"), (4, "c", 5.0, "down")],
        "id long, category string, rating double, text_ string")

    def make_client():
        seen = {}

        def ask(settings, prompt):
            key = settings["answer"], prompt
            seen[key] = seen.get(key, 0) + 1
            if "down" in prompt:
                raise OSError("unreachable")
            if "broken" in prompt or ("flaky" in prompt and seen[key] < 3):
                return "no json"
            return '{"label": "%s", "explanation": "%s"}' % (settings["answer"], "why")

        return ask

    found = {(r.id, r.variant): r for r in score_remotely(
        df, make_client, {"x": {"answer": "CG"}, "y": {"answer": "OR"}}, concurrency=4, retries=3, wait=0.0).collect()}
    assert len(found) == 8
    assert (found[1, "x"].predicted_label, found[1, "x"].attempts, found[1, "y"].predicted_label) == ("CG", 1, "OR")
    assert (found[2, "x"].predicted_label, found[2, "x"].attempts, found[2, "x"].explanation) == (None, 4, "")
    assert found[3, "y"].attempts == 3 and found[3, "y"].error is None
    assert found[4, "x"].error == "OSError: unreachable"
