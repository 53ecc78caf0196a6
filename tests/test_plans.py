"""Plan shapes that must hold at any scale."""

import re

import pytest

from veriscope.plans import registry
from veriscope.plans.tables import documents, joined_facts, wide
from veriscope.functions.text import with_native_features, without_helpers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_stay_in_the_jvm_without_shuffle(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS id", "text AS text_")
    shown = plan(without_helpers(with_native_features(texts)).drop("text_"))
    assert "Exchange" not in shown and "Python" not in shown


def test_reports_do_not_shuffle_texts(spark, sf_dir):
    """The measured numbers, not the texts, enter the join with the labels."""
    shown = plan(joined_facts(spark, sf_dir))
    join = shown.index("Join")
    assert re.search(r"size\(array", shown[join:])
    # audits read the numbers that are stored
    assert "text" not in re.sub(r"Location: [^\n]*", "", plan(wide(spark, sf_dir)))


def test_no_row_level_step_in_a_single_task(spark, sf_dir):
    for name in ("model_agreement", "category_accuracy", "tfidf_vectors", "stratified_split", "text_features_full"):
        shown = plan(registry.QUERIES[name](spark, sf_dir))
        for line in shown.splitlines():
            if "SinglePartition" in line:
                pytest.fail(f"{name}: {line}")


def test_only_needed_columns_are_read(spark, sf_dir):
    shown = plan(registry.QUERIES["label_encoding"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,quality:int>" in shown
    assert "n_chars" not in plan(documents(spark, sf_dir).select("id", "text_"))


def test_scores_are_worked_out_alone(spark, sf_dir, monkeypatch):
    """A query of one lexicon score neither counts patterns for other features nor runs a lambda for every word."""
    from veriscope.plans import measures, tables

    built = {}
    for module in (measures, tables):
        monkeypatch.setattr(module, "stored", lambda s, d, name, build, *of: built.setdefault(name, build()))
    for query in (measures.cohort_sentiment_by_rating, measures.polarity_by_difficulty, measures.concreteness_by_difficulty):
        query(spark, sf_dir)
    assert "scores" in built and not {"profile", "features"} & set(built)
    plans = {name: df._jdf.queryExecution().optimizedPlan().toString() for name, df in built.items()}
    assert "regexp_count" not in plans["scores"] and "lambda" not in plans["lexicon"]
