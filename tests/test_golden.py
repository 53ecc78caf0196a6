"""Published numbers, rebuilt from the eight agreement patterns."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veriscope.functions.stats import wilson_bounds
from veriscope.operators.consolidate import difficulty, majority_vote
from veriscope.operators.metrics import (
    accuracy_by, agreement, difficulty_summary, overall_accuracy, paired_tests,
)

MODELS = ("fcnn", "rf", "xgb")
# Published pattern counts.
PATTERNS = [
    ("1-1-1", 6489), ("0-1-1", 466), ("1-0-1", 344), ("1-0-0", 296),
    ("0-0-0", 185), ("1-1-0", 165), ("0-0-1", 109), ("0-1-0", 33),
]
# Published rows and right answers per category.
CATEGORIES = [("Books_5", 877, 798, 763, 795), ("Pet_Supplies_5", 894, 806, 780, 812)]


@pytest.fixture(scope="module")
def wide(spark):
    counted = spark.createDataFrame(PATTERNS, "pattern string, n int")
    flags = F.split("pattern", "-")
    return counted.select(
        *[flags[i].cast("int").alias(m) for i, m in enumerate(MODELS)],
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"),
    )


def test_agreement(wide):
    assert rows(agreement(wide, MODELS)) == PATTERNS


def test_accuracy_and_vote(wide):
    found = dict(rows(overall_accuracy(wide, MODELS, ensemble=True)))
    assert {m: round(a, 6) for m, a in found.items()} == {
        "fcnn": 0.901941, "rf": 0.884506, "xgb": 0.916038, "ensemble": 0.922963,
    }
    assert wide.agg(F.sum(majority_vote(MODELS))).first()[0] == 7464


def test_difficulty(wide):
    scored = wide.select(difficulty(MODELS).alias("difficulty"))
    assert rows(difficulty_summary(scored)) == [(0, 6489, "80.2%"), (1, 975, "12.1%"), (2, 438, "5.4%"), (3, 185, "2.3%")]


def test_mcnemar(wide):
    found = {(r["first"], r["second"]): r for r in paired_tests(wide, MODELS, p_values=True).collect()}
    expected = {
        ("fcnn", "rf"): (6654, 640, 499, 294, 17.208077, 3.350e-05),
        ("fcnn", "xgb"): (6833, 461, 575, 218, 12.325290, 4.469e-04),
        ("rf", "xgb"): (6955, 198, 453, 481, 99.102919, 2.397e-23),
    }
    for pair, (both, first, second, neither, chi2, p) in expected.items():
        row = found[pair]
        assert (row.both_correct, row.first_only, row.second_only, row.both_wrong) == (both, first, second, neither)
        assert round(row.chi2, 6) == chi2
        assert row.p_value == pytest.approx(p, rel=1e-3)
        assert row.significant


def test_category_accuracy(spark):
    base = spark.createDataFrame(CATEGORIES, "category string, n int, a int, b int, c int")
    wide = base.select("category", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"), "a", "b", "c").select(
        "category", *[(F.col("k") <= F.col(c)).cast("int").alias(m) for c, m in zip("abc", MODELS)]
    )
    found = rows(accuracy_by(wide, MODELS, "category"))
    for row, (category, n, *right) in zip(found, CATEGORIES):
        assert row[:2] == (category, n)
        assert row[2:] == pytest.approx([r / n for r in right])


def test_wilson(spark):
    low, high = wilson_bounds(F.lit(441), F.lit(500))
    found = spark.range(1).select(low, high).first()
    assert [round(x, 6) for x in found] == [0.850768, 0.907407]
    assert tuple(spark.range(1).select(*wilson_bounds(F.lit(0), F.lit(0))).first()) == (None, None)
