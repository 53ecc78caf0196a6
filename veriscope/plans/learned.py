"""Fitted classifiers, projections and supplied models over the given tables.

Classifiers are fitted with all their trees, rounds, folds, trials and epochs, on all labelled rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from veriscope.learning.boosting import boosted_importances, boosted_predictions
from veriscope.learning.classifiers import fit_features, vector_category_rating, with_vector
from veriscope.learning.evaluation import difficulty_importances
from veriscope.learning.network import fit_network, network_scores
from veriscope.learning.remote import score_remotely
from veriscope.learning.text_forests import forest_curve, forest_importances, forest_predictions, forest_search
from veriscope.learning.vectors import (
    annotate, encode, explained_variance, fit_projection, hashed_word_vectors, project, star_sentiment,
)
from veriscope.learning.word_vectors import SIZE, fit_word_vectors, text_vectors
from veriscope.operators.consolidate import any_error, difficulty
from veriscope.operators.metrics import accuracy_with_interval, best_epoch, fold_summary
from veriscope.operators.selection import hash_fraction, stratified_split
from veriscope.plans.ctes import sql
from veriscope.plans.measures import CORRELATED, native_features
from veriscope.plans.tables import MODELS, dealt, documents, labels, reviews, rounded, wide
from veriscope.shared import settle

VARIANTS = {"basic": {"shift": 0}, "improved": {"shift": 1}}


def _marked(spark, sf_dir):
    """All labelled texts and whether they train, joined and written once: fitting reads them several times."""
    placed = stratified_split(reviews(spark, sf_dir))
    return settle(placed.withColumn("trains", F.col("part") == "train").drop("part"))


def rf_predictions(spark, sf_dir):
    return forest_predictions(_marked(spark, sf_dir), "random_forest")


def gbt_predictions(spark, sf_dir):
    return boosted_predictions(_marked(spark, sf_dir), "boosted_trees")


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def _vector_parts(spark, sf_dir):
    keyed = documents(spark, sf_dir).drop("text_").join(labels(spark, sf_dir), "id")
    placed = settle(stratified_split(with_vector(keyed, _vectors(spark, sf_dir))))
    return placed.where("part = 'train'").drop("part"), placed.where("part = 'test'").drop("part")


def _network(spark, sf_dir):
    """Feature stages, weights and history; epochs are chosen on a part of the training rows."""
    train, _ = _vector_parts(spark, sf_dir)
    usable = train.where("embedding IS NOT NULL").withColumn("held", hash_fraction(seed=7) < 0.2)
    prepared, vectors = fit_features(usable, vector_category_rating(), keep=["held"])
    weights, history = fit_network(vectors.where("NOT held"), vectors.where("held"))
    return prepared, weights, history


def mlp_predictions(spark, sf_dir):
    """The network's answer for every test text; none for a text without vector."""
    _, test = _vector_parts(spark, sf_dir)
    prepared, weights, _ = _network(spark, sf_dir)
    names = prepared.stages[0].labels
    coded = PipelineModel(stages=prepared.stages[1:]).transform(test.where("embedding IS NOT NULL"))
    over = (F.col("p") > 0.5).cast("int")
    scored = network_scores(coded, weights, "id", "label").select(
        "id", "label", F.array(*map(F.lit, names))[over].alias("predicted_label"),
        over.alias("over_threshold"), F.round("p", 3).alias("p_genuine"),
    )
    return scored.unionByName(test.where("embedding IS NULL").select("id", "label"), allowMissingColumns=True)


def mlp_history(spark, sf_dir):
    """Training loss, validation loss and accuracy by epoch, until the validation loss stops improving."""
    return rounded(_network(spark, sf_dir)[2], digits=3)


def mlp_best_epoch(spark, sf_dir):
    history = _network(spark, sf_dir)[2].drop("loss").withColumn("model", F.lit("network"))
    return rounded(best_epoch(history), digits=3)


def feature_importance(spark, sf_dir):
    return rounded(forest_importances(_marked(spark, sf_dir)))


def boosted_importance(spark, sf_dir):
    """The features whose cuts gain most in the boosted trees."""
    return rounded(boosted_importances(_marked(spark, sf_dir)))


def difficulty_importance(spark, sf_dir):
    measured = native_features(spark, sf_dir).select("id", *CORRELATED)
    judged = wide(spark, sf_dir).select("id", difficulty(MODELS).alias("difficulty")).join(measured, "id")
    return rounded(difficulty_importances(judged, CORRELATED, depth=30))


def curve(spark, sf_dir):
    return rounded(fold_summary(forest_curve(settle(reviews(spark, sf_dir))), by="fraction"))


def param_search(spark, sf_dir):
    return rounded(forest_search(settle(reviews(spark, sf_dir))))


def pca_2d(spark, sf_dir):
    """All vectors on two principal components, with the any-error flag of the labelled ones."""
    vectors = _vectors(spark, sf_dir)
    model = fit_projection(vectors)
    flags = wide(spark, sf_dir).select("id", any_error(MODELS).alias("any_error"))
    placed = project(model, vectors).select(
        "id", F.col("components")[0].alias("x"), F.col("components")[1].alias("y"),
        *[F.lit(v).alias(f"variance_{i + 1}") for i, v in enumerate(explained_variance(model))],
    )
    return rounded(placed.join(flags, "id", "left"))


def pca_50(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    reduced = project(fit_projection(vectors, 50), vectors)
    return rounded(reduced.select("id", F.size("components").alias("dimensions"),
                                  F.aggregate("components", F.lit(0.0), lambda a, x: a + x * x).alias("energy")))


def pca_energy(spark, sf_dir):
    """Squared length of every vector in all its components: the squared distance from the mean."""
    vectors = _vectors(spark, sf_dir)
    length = vectors.where(F.col("embedding").isNotNull()).select(F.size("embedding")).first()[0]
    placed = project(fit_projection(vectors, length), vectors)
    return rounded(placed.select("id", F.aggregate("components", F.lit(0.0), lambda a, x: a + x * x).alias("energy")), digits=4)


def word_vectors(spark, sf_dir):
    """Hashed word directions averaged by text, in eight places."""
    vectors = hashed_word_vectors(documents(spark, sf_dir), size=8)
    return rounded(vectors.select("id", *[F.col("embedding")[i].alias(f"v{i}") for i in range(8)]))


def trained_vectors(spark, sf_dir):
    """Document vectors from word vectors fitted on all texts: their number of places and squared length."""
    texts = dealt(spark, sf_dir)
    vectors = text_vectors(texts, fit_word_vectors(texts), SIZE)
    return rounded(vectors.select("id", F.size("embedding").alias("places"),
                                  F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("energy")), digits=3)


def _length_encoder():
    def run(texts):
        return np.array([[len(t), t.count(" ")] for t in texts], dtype="float32")

    return run


def encoded_texts(spark, sf_dir):
    """Vectors from a supplied encoder (here: characters and blanks)."""
    vectors = encode(documents(spark, sf_dir), _length_encoder)
    return vectors.select("id", F.col("embedding")[0].cast("long").alias("chars"),
                          F.col("embedding")[1].cast("long").alias("blanks"))


def _length_scorer():
    def run(texts):
        return np.array([[-abs(len(t) % 5 - j) for j in range(5)] for t in texts], dtype="float32")

    return run


def scored_stars(spark, sf_dir):
    """Stars and confidence from a supplied scorer (here: by length)."""
    return rounded(star_sentiment(documents(spark, sf_dir), _length_scorer).select("id", "stars", "confidence"))


def _digit_annotator():
    def run(text):
        return {"digits": sum(c in "0123456789" for c in text), "commas": text.count(",")}

    return run


def annotated_texts(spark, sf_dir):
    """Numbers from a supplied annotator (here: digits and commas)."""
    return annotate(documents(spark, sf_dir), _digit_annotator, ["digits", "commas"])


def _length_client():
    def ask(settings, prompt):
        size = len(prompt.split("Review: ", 1)[1]) - 1 + settings["shift"]
        if size % 7 == 0:
            return "no idea"
        return '{"label": "CG"}' if size % 3 == 0 else '{"label": "OR"}'

    return ask


def _answers(spark, sf_dir):
    return score_remotely(reviews(spark, sf_dir), _length_client, VARIANTS, retries=2, wait=0.0)


def llm_scored(spark, sf_dir):
    """Answers of a remote scorer (here: by length) for two prompt variants."""
    return _answers(spark, sf_dir).select("id", "variant", "predicted_label", "explanation", "attempts")


def prompt_variants(spark, sf_dir):
    """Accuracy and interval of each prompt variant on the same texts."""
    judged = _answers(spark, sf_dir).join(labels(spark, sf_dir), "id").withColumn(
        "correct", F.when(F.col("predicted_label").isNotNull(), (F.col("label") == F.col("predicted_label")).cast("int"))
    )
    return rounded(accuracy_with_interval(judged, "variant"))


QUERIES = {
    "rf_predictions": rf_predictions,
    "gbt_predictions": gbt_predictions,
    "mlp_predictions": mlp_predictions,
    "mlp_history": mlp_history,
    "mlp_best_epoch": mlp_best_epoch,
    "feature_importance": feature_importance,
    "boosted_importance": boosted_importance,
    "difficulty_importance": difficulty_importance,
    "learning_curve": curve,
    "param_search": param_search,
    "pca_2d": pca_2d,
    "pca_50": pca_50,
    "pca_energy": pca_energy,
    "word_vectors": word_vectors,
    "trained_vectors": trained_vectors,
    "encoded_texts": encoded_texts,
    "scored_stars": scored_stars,
    "annotated_texts": annotated_texts,
    "llm_scored": llm_scored,
    "prompt_variants": prompt_variants,
}

ASKED = """, asked AS (
    SELECT id, label, variant, length(text_) + shift AS n
    FROM reviews CROSS JOIN (VALUES ('basic', 0), ('improved', 1)) v(variant, shift)),
  answered AS (
    SELECT id, label, variant, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 3 = 0 THEN 'CG' ELSE 'OR' END AS predicted_label,
           CASE WHEN n % 7 = 0 THEN 3 ELSE 1 END AS attempts FROM asked)
"""

PLACES = ", ".join(
    f"round(sum(CASE WHEN place = {i} THEN sign ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS v{i}" for i in range(8))

ORACLE = {
    "pca_energy": """
        WITH cells AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
        means AS (SELECT i, avg(x) AS m FROM cells GROUP BY i)
        SELECT v.vec_id AS id, round(sum((x - m) ^ 2), 4) AS energy
        FROM embeddings v LEFT JOIN (cells JOIN means USING (i)) c ON v.vec_id = c.id GROUP BY v.vec_id""",
    "word_vectors": sql(rf"""
        , hashed AS (
          SELECT id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS n
          FROM (SELECT id, unnest(regexp_extract_all(lower(text_), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM docs)),
        placed AS (SELECT id, (n // 2) % 8 AS place, CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END AS sign FROM hashed),
        vectors AS (SELECT id, {PLACES} FROM placed GROUP BY id)
        SELECT d.id, v.* EXCLUDE (id) FROM docs d LEFT JOIN vectors v ON d.id = v.id""", "docs"),
    "encoded_texts": sql("""
        SELECT id, length(text_) AS chars, length(text_) - length(replace(text_, ' ', '')) AS blanks FROM docs""", "docs"),
    "scored_stars": sql("""
        SELECT id, CAST(k + 1 AS INTEGER) AS stars,
               round(1 / (exp(-CAST(abs(k - 0) AS DOUBLE)) + exp(-abs(k - 1)) + exp(-abs(k - 2)) + exp(-abs(k - 3))
                     + exp(-abs(k - 4))), 6) AS confidence
        FROM (SELECT id, length(text_) % 5 AS k FROM docs)""", "docs"),
    "annotated_texts": sql("""
        SELECT id, CAST(length(text_) - length(regexp_replace(text_, '[0-9]', '', 'g')) AS DOUBLE) AS digits,
               CAST(length(text_) - length(replace(text_, ',', '')) AS DOUBLE) AS commas FROM docs""", "docs"),
    "llm_scored": sql(ASKED + """
        SELECT id, variant, predicted_label, '' AS explanation, CAST(attempts AS INTEGER) AS attempts FROM answered""",
                      "reviews"),
    "prompt_variants": sql(ASKED + """
        , judged AS (
          SELECT variant, CAST(count(predicted_label) AS DOUBLE) AS n, count(predicted_label) AS n_valid,
                 count(*) FILTER (WHERE label = predicted_label) AS n_correct, CAST(1.959963984540054 AS DOUBLE) AS z
          FROM answered GROUP BY variant)
        SELECT variant, n_valid, n_correct, round(n_correct / n, 6) AS accuracy,
               round((n_correct / n + z * z / (2 * n) - z * sqrt(n_correct / n * (1 - n_correct / n) / n + z * z / (4 * n * n)))
                     / (1 + z * z / n), 6) AS ci_low,
               round((n_correct / n + z * z / (2 * n) + z * sqrt(n_correct / n * (1 - n_correct / n) / n + z * z / (4 * n * n)))
                     / (1 + z * z / n), 6) AS ci_high
        FROM judged""", "reviews"),
}
