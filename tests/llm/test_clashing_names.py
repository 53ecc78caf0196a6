"""Every stage keeps further columns that are named like its own intermediate ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veriscope.shared import settle

PROSE = "the house of the old man and the sea is in a book that it is for everyone to read on a day like this one\n"
NAMES = ["_row", "_runs", "_kept", "_new", "_found", "_given", "_text", "_part", "_changed", "_spans", "_n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"number {i}: " + PROSE + f"{'other ' * i}token=abcdef{i}", "en", "ab"[i % 2], i) for i in range(8)]
    made = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string, n_chars long")
    return settle(made.withColumns({name: F.concat(F.lit(name), F.col("doc_id")) for name in NAMES}))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES if n != "best_fit_packing"])
def test_stage_keeps_the_columns(spark, docs, sf_dir, name):
    result = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert result.columns == docs.columns
    found = result.collect()
    assert found
    for row in found:
        assert [row[n] for n in NAMES] == [f"{n}{row.doc_id}" for n in NAMES]
