"""Texts that some or all models left out, and files as real users have them."""

import pytest
from pyspark.sql import functions as F

from veriscope.functions.stats import chi2_p_value, erfc
from veriscope.operators.consolidate import all_wrong, any_error, cohort, difficulty, joint_failures, majority_vote
from veriscope.operators.metrics import agreement
from veriscope.operators.selection import number_rows
from veriscope.sources.predictions import write_predictions
from veriscope.sources.reviews import category_rows, import_reviews, read_csv_by_name

MODELS = ("a", "b", "c")


def test_one_rule_for_missing_answers(spark):
    rows = [(1, "CG", 1, None, 0), (2, "CG", None, None, None), (3, "OR", None, None, None), (4, "CG", None, 0, None),
            (5, "CG", 1, 1, None), (6, "CG", 0, None, 0), (7, "CG", 0, 0, 0)]
    df = spark.createDataFrame(rows, "id int, label string, a int, b int, c int")
    flags = [difficulty(MODELS), majority_vote(MODELS), any_error(MODELS), all_wrong(MODELS), cohort(MODELS), joint_failures(MODELS)["all_wrong"]]
    got = {r[0]: tuple(r)[1:] for r in df.select("id", *flags).collect()}
    assert got == {
        1: (1, 0, 1, False, "fake_caught", False), 2: (None, None, None, False, None, False),
        3: (None, None, None, False, "genuine", False), 4: (1, 0, 1, True, "fake_caught", True),
        5: (0, 1, 0, False, "fake_caught", False), 6: (2, 0, 1, True, "fake_escaped", True), 7: (3, 0, 1, True, "fake_escaped", True),
    }


def test_agreement_keeps_patterns_with_gaps_apart(spark):
    df = spark.createDataFrame([(1, None, 0), (1, 0, None), (1, 0, 1)], "a int, b int, c int")
    assert {r.pattern: r["count"] for r in agreement(df, MODELS).collect()} == {"1---0": 1, "1-0--": 1, "1-0-1": 1}


def test_p_values_without_python(spark):
    import math

    values = [0.0, 1e-9, 0.5, 1.9999, 2.0, 2.5, 5.0, 10.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(erfc(F.col("x"))).collect()
    for v, r in zip(values, got):
        assert r[0] == pytest.approx(math.erfc(v), rel=1e-9, abs=1e-15)
    none = spark.createDataFrame([(None,)], "x double").select(chi2_p_value("x")).first()
    assert none[0] is None


def test_reviews_are_imported_by_name_in_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('label,category,text_,rating\nOR,k,"first, ""quoted""\nline",5.0\n', encoding="utf-8")
    body = "".join(f"{5 - i % 5}.0,CG,text {i},c{i}\n" for i in range(2000))
    (tmp_path / "b.csv").write_text("﻿rating,label,text_,category\n" + body + "many,CG,last,z\n", encoding="utf-8")
    rows = {r.id: r for r in import_reviews(spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(1, 2003))
    assert (rows[1].category, rows[1].rating, rows[1].label, rows[1].text_) == ("k", 5.0, "OR", 'first, "quoted"\nline')
    assert [rows[2 + i].text_ for i in range(2000)] == [f"text {i}" for i in range(2000)]
    assert (rows[2002].rating, rows[2002].category) == (None, "z")
    with pytest.raises(ValueError, match="no column stars"):
        read_csv_by_name(spark, str(tmp_path), ["stars"])


def test_part_files_are_ordered_by_number(spark, tmp_path):
    for part, value in (("part-100000", 3), ("part-10001", 2), ("part-00002", 1)):
        spark.range(value, value + 1).coalesce(1).write.parquet(str(tmp_path / "x" / part))
    import glob
    import os

    for part in ("part-100000", "part-10001", "part-00002"):
        (found,) = glob.glob(str(tmp_path / "x" / part / "part-*.parquet"))
        os.makedirs(tmp_path / "y", exist_ok=True)
        os.link(found, tmp_path / "y" / f"{part}-c000.parquet")
    numbered = number_rows(spark.read.parquet(str(tmp_path / "y")), "no")
    assert [(r.no, r.id) for r in numbered.orderBy("no").collect()] == [(1, 1), (2, 2), (3, 3)]


def test_written_predictions_are_clustered(spark, tmp_path):
    df = spark.range(4000).select("id", (F.col("id") % 3).cast("string").alias("model"), (F.col("id") % 2).cast("int").alias("correct"))
    write_predictions(df.repartition(8), str(tmp_path / "p"))
    import glob

    assert len(glob.glob(str(tmp_path / "p" / "*" / "*" / "part-*"))) <= 12
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4000


def test_category_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, category string")
    assert sorted(map(tuple, category_rows(df).collect())) == [(1, "a", 1.0), (3, "b", 1.0)]
