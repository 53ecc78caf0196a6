"""Reading and writing files."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veriscope.operators.consolidate import consolidate
from veriscope.shared import pinned, settle, shared_folder
from veriscope.sources.lexicons import read_concreteness
from veriscope.sources.predictions import (
    prediction_files, read_predictions, write_prediction_files, write_predictions,
)
from veriscope.sources.reviews import (
    columns_with_prefix, encoded_label, enrich, import_reviews, new_columns, scaled_stars, without_nan,
)
from veriscope.sources.store import manifest, materialize, publish, published

REVIEWS = '''category,rating,label,text_
Books_5,5.0,OR,"Two lines
and ""quotes"", commas"
Toys_5,1.0,CG,
Books_5,3.0,CG,"plain"
'''


def test_reviews_are_numbered_in_file_order(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(REVIEWS, encoding="utf-8-sig")
    found = import_reviews(spark, str(path))
    assert rows(found.select("id", "category", "rating", "label", "text_"), "id") == [
        (1, "Books_5", 5.0, "OR", 'Two lines\nand "quotes", commas'), (2, "Toys_5", 1.0, "CG", None),
        (3, "Books_5", 3.0, "CG", "plain")]


def test_enrichment(spark):
    df = spark.createDataFrame([(1, "x", 5.0, "OR", 1.0), (2, "y", 1.0, "CG", 3.0)],
                               "id long, category string, rating double, label string, stars double")
    out = enrich(df, encode_label=True, normalize_rating=True, one_hot=True)
    found = {r.id: r for r in out.collect()}
    assert (found[1].label_encoded, found[1].rating_norm, found[1].stars) == (1, 1.0, 0.0)
    assert found[1].category == "x" and found[1].category_onehot.toArray().tolist() == [1.0, 0.0]
    assert new_columns(out, df.columns) == ["category_onehot", "label_encoded", "rating_norm"]
    assert columns_with_prefix(out, ["category_"], ["rating_norm"]) == ["category_onehot", "rating_norm"]
    assert spark.range(1).select(encoded_label(F.lit("??")), scaled_stars(F.lit(3))).first() == (None, 0.5)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert without_nan(df).agg(F.avg("x")).first()[0] == 1.0


def test_prediction_files_with_different_headers(spark, tmp_path):
    (tmp_path / "correct_predictions_llm.csv").write_text(
        'category,rating,label,predicted_label,explanation,text_,id\nToys,5.0,CG,CG,,"a\nb",7\n', encoding="utf-8-sig")
    (tmp_path / "wrong_predictions_random_forest.csv").write_text(
        "category,rating,label,text_,id\nBooks,1.0,OR,text,8\nToys,5.0,CG,\"a\nb\",7\n")
    (tmp_path / "correct_predictions_random_forest.csv").write_text("category,rating,label,text_,id\nArt,2.0,OR,z,9\n")
    (tmp_path / "combined_predictions.csv").write_text("id,category\n1,old\n")
    assert len(prediction_files(spark, str(tmp_path))) == 3
    found = read_predictions(spark, str(tmp_path))
    assert rows(found.select("model", "correct", "id", "category", "rating", "text_"), "model", "id") == [
        ("llm", 1, 7, "Toys", 5.0, "a\nb"),
        ("random_forest", 0, 7, "Toys", 5.0, "a\nb"), ("random_forest", 0, 8, "Books", 1.0, "text"),
        ("random_forest", 1, 9, "Art", 2.0, "z")]
    wide = consolidate(found, ["llm", "random_forest"], ["category", "rating", "label", "text_"])
    assert rows(wide.select("id", "llm", "random_forest", "correct_count"), "id") == [
        (7, 1, 0, 1), (8, None, 0, 0), (9, None, 1, 1)]


def test_written_predictions_read_back(spark, tmp_path):
    df = spark.createDataFrame(
        [("m one", 1, 2, "x", 1.0, "OR", 'say "hi"\nthere'), ("m one", 0, 1, "y", 2.0, "CG", "b"),
         ("other", 1, 1, "y", 2.0, "CG", "b")],
        "model string, correct int, id long, category string, rating double, label string, text_ string")
    write_prediction_files(df, str(tmp_path / "csv"), ["m one", "other"])
    back = read_predictions(spark, str(tmp_path / "csv")).select(*df.columns)
    assert back.exceptAll(df).count() == 0 and back.count() == 3
    write_predictions(df, str(tmp_path / "parquet"))
    stored = spark.read.parquet(str(tmp_path / "parquet"))
    assert stored.where("model = 'm one' AND correct = 1").count() == 1 and stored.count() == 3


def test_missing_predictions_are_an_error(spark, tmp_path):
    (tmp_path / "note.csv").write_text("a\n1\n")
    with pytest.raises(FileNotFoundError):
        read_predictions(spark, str(tmp_path))


def test_lexicon_file(spark, tmp_path):
    path = tmp_path / "ratings.txt"
    path.write_text("Word\tBigram\tConc.M\nroadsweeper\t0\t4.85\ntraindriver\t0\t4.54\nodd\t0\tn/a\n")
    assert rows(read_concreteness(spark, str(path)), "word") == [("odd", None), ("roadsweeper", 4.85), ("traindriver", 4.54)]


def test_materialized_once_per_parameters(spark, tmp_path):
    calls = []

    def build(n):
        calls.append(n)
        return spark.range(n)

    for n in (3, 3, 5):
        assert materialize(spark, str(tmp_path), "numbers", lambda: build(n), {"n": n}).count() == n
    assert calls == [3, 5]


def test_materialized_again_when_an_input_changes(spark, tmp_path):
    import os

    calls, folder = [], tmp_path / "inputs"
    folder.mkdir()
    (folder / "a.txt").write_text("one")

    def get(n):
        return materialize(spark, str(tmp_path / "out"), "table", lambda: calls.append(n) or spark.range(n), {"k": 1}, [str(folder)]).count()

    assert get(3) == 3 and get(4) == 3 and calls == [3]
    (folder / "b.txt").write_text("more")
    assert get(5) == 5 and get(6) == 5
    (folder / "a.txt").write_text("two")
    os.utime(folder / "a.txt", (1_000_000, 1_000_000))
    assert get(7) == 7 and calls == [3, 5, 7]
    assert manifest(spark, [str(folder)])["files"] == 2 and manifest(spark, []) == {}


def test_two_writers_leave_one_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(2).write.parquet(f"{folder}/x")
    spark.range(9).write.parquet(f"{folder}/y")
    assert published(spark, folder) is None
    assert publish(spark, folder, "x").endswith("/x") and publish(spark, folder, "y").endswith("/x")
    assert published(spark, folder).endswith("/x")

    def build():
        # another writer ends while this one builds
        if not calls:
            calls.append(1)
            assert materialize(spark, str(tmp_path), "raced", build).count() == 5
        return spark.range(5 if len(calls) == 1 else 6)

    calls = []
    assert materialize(spark, str(tmp_path), "raced", build).count() == 5
    assert materialize(spark, str(tmp_path), "raced", lambda: spark.range(0)).count() == 5


def test_data_rows_equal_to_the_header_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text(REVIEWS + "category,rating,label,text_\n")
    (tmp_path / "b.csv").write_text("label,text_,rating,category\nOR,x,2.0,Toys_5\nlabel,text_,rating,category\n")
    found = import_reviews(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r.category, r.text_ or "") for r in found.collect()) == sorted([
        ("Books_5", 'Two lines\nand "quotes", commas'), ("Toys_5", ""), ("Books_5", "plain"), ("category", "text_"),
        ("Toys_5", "x"), ("category", "text_")])


def test_shared_tables(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "id long, v array<double>")
    assert settle(df).exceptAll(df).count() == 0
    assert rows(pinned(df), "id") == rows(df, "id")
    assert pinned(df, max_rows=1) is df
    empty = pinned(df.where("id > 5"))
    assert empty.count() == 0 and empty.columns == ["id", "v"]


class _Session:
    """A session without a shared folder, on the given master."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    def __init__(self, master):
        self.sparkContext = type("C", (), {
            "master": master, "applicationId": "app-test", "getCheckpointDir": staticmethod(lambda: None)})


def test_only_a_local_session_may_use_its_own_folder():
    folder = shared_folder(_Session("local[2]"))
    assert folder and folder == shared_folder(_Session("local[2]"))
    with pytest.raises(RuntimeError):
        shared_folder(_Session("spark://host:7077"))


def test_folder_of_the_session(spark):
    assert shared_folder(spark).removeprefix("file:") in settle(spark.range(3)).inputFiles()[0]
