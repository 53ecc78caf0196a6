"""Splits, samples, quantiles and row numbers."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from veriscope.functions.bins import bin_label, fixed_bin_no, with_quantile_bins
from veriscope.operators.quantiles import exact_quantiles
from veriscope.operators.selection import (
    fold_no, holdout_split, nested_samples, number_rows, seeded_sample, split_quotas, stratified_split,
)


def labelled(spark, n=1000, partitions=3):
    return spark.range(n).withColumn(
        "label", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 997 == 1, "single").otherwise("common")
    ).repartition(partitions)


def test_split_has_exact_quotas_and_is_stable(spark):
    parts = stratified_split(labelled(spark))
    counts = {(r.label, r.part): r["count"] for r in parts.groupBy("label", "part").count().collect()}
    assert sum(v for (_, part), v in counts.items() if part == "test") == math.ceil(0.2 * 1000)
    assert counts["rare", "test"] == 20
    assert sum(counts.values()) == 1000
    again = stratified_split(labelled(spark, partitions=7))
    assert parts.exceptAll(again).count() == 0
    by_hand = labelled(spark).selectExpr("*", "md5(concat('42:', cast(id AS string))) AS h").toPandas()
    for label, group in by_hand.groupby("label"):
        ordered = group.sort_values(["h", "id"])["id"].tolist()
        test = {r.id for r in parts.where((F.col("label") == label) & (F.col("part") == "test")).collect()}
        assert test == set(ordered[: counts.get((label, "test"), 0)])


def test_quotas_use_largest_remainders(spark):
    counts = spark.createDataFrame([("a", 7), ("b", 9), ("c", 4)], "label string, n long")
    assert rows(split_quotas(counts, 0.2).select("label", "quota"), "label") == [("a", 1), ("b", 2), ("c", 1)]


def test_samples_are_nested_and_guarded(spark):
    df = labelled(spark)
    small, large = (set(rows(seeded_sample(df, n).select("id"))) for n in (50, 200))
    assert len(small) == 50 and small < large
    sizes = dict(nested_samples(df, [50, 200]).groupBy("sample_size").count().collect())
    assert sizes == {50: 50, 200: 200}
    with pytest.raises(ValueError):
        seeded_sample(df, 1001)


def test_holdout_and_folds_cover_everything(spark):
    df = holdout_split(labelled(spark)).withColumn("fold", fold_no(3))
    share = df.where("part = 'test'").count() / 1000
    assert 0.15 < share < 0.25
    assert {r.fold for r in df.select("fold").distinct().collect()} == {0, 1, 2}


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_quantiles_equal_numpy(spark, accuracy):
    """accuracy 100 makes the sketch bracket much smaller than the group."""
    rng = random.Random(1)
    values = [("skewed", 7.0 if rng.random() < 0.4 else rng.lognormvariate(0, 4)) for _ in range(20_000)]
    values += [("one", 3.0)] + [("few", float(v)) for v in (1, 2, 4, 8)] + [("none", None)]
    df = spark.createDataFrame(values, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]
    found = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, "v", probs, ["g"], accuracy).collect()}
    for group in ("skewed", "one", "few"):
        data = [v for g, v in values if g == group]
        for p in probs:
            assert found[group, p] == pytest.approx(np.quantile(data, p), rel=1e-12)
    assert not any(g == "none" for g, _ in found)
    whole = {r.prob: r.quantile for r in exact_quantiles(df, "v", probs, accuracy=accuracy).collect()}
    data = [v for _, v in values if v is not None]
    assert whole == pytest.approx({p: np.quantile(data, p) for p in probs}, rel=1e-12)


def test_quantile_bins(spark):
    even = spark.createDataFrame([(i,) for i in range(1, 101)], "n int")
    binned = with_quantile_bins(even, "n", unit="")
    assert rows(binned.groupBy("bin_no", "bin_label").count(), "bin_no") == [
        (1, "1–20", 20), (2, "21–40", 20), (3, "41–60", 20), (4, "61–80", 20), (5, "81–100", 20)]
    same = with_quantile_bins(spark.createDataFrame([(4,)] * 5, "n int"), "n")
    assert {r.bin_no for r in same.collect()} == {1}


def test_fixed_bins(spark):
    df = spark.createDataFrame([(0,), (1,), (20,), (21,), (9999,), (10_000_000,)], "n int")
    found = [tuple(r) for r in df.select(fixed_bin_no(F.col("n")), bin_label(fixed_bin_no(F.col("n")))).collect()]
    assert found == [(None, None), (1, "1–20"), (1, "1–20"), (2, "21–50"), (6, "500+"), (6, "500+")]


def test_row_numbers_follow_file_order(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100).repartition(4).write.parquet(path)
    stored = spark.read.parquet(path)
    numbered = number_rows(stored, "row")
    found = [r.row for r in numbered.orderBy("row").collect()]
    assert found == list(range(1, 101))
