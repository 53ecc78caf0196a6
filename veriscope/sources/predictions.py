"""Prediction files: one pair (correct, wrong) per model, and one partitioned table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.sources.reviews import read_csv_by_name

BASE_COLUMNS = ("id", "category", "rating", "label", "text_")
# Fixed value: how a prediction file is named.
FILE_NAME = r"(correct|wrong)_predictions_([^/]+?)\.csv"


def prediction_files(spark: SparkSession, folder: str) -> list[str]:
    """The prediction files (or directories of part files) below a folder; no other CSV."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select(F.regexp_extract("path", rf"^(.*/{FILE_NAME})(/|$)", 1).alias("file"))
        .where("file <> ''").distinct()
    )
    return sorted(row.file for row in found.toLocalIterator())  # two names per model


def read_predictions(spark: SparkSession, folder: str, columns: Sequence[str] = BASE_COLUMNS) -> DataFrame:
    """Every model's predictions as (model, correct, columns…).

    Files may differ in column order and in which of the columns they have.
    """
    files = prediction_files(spark, folder)
    if not files:
        raise FileNotFoundError(f"no prediction files in {folder}")
    raw = read_csv_by_name(spark, files, columns, optional=columns)
    source = F.url_decode(F.regexp_replace("_file", r"\+", "%2B"))
    return raw.select(
        F.regexp_extract(source, FILE_NAME, 2).alias("model"),
        (F.regexp_extract(source, FILE_NAME, 1) == "correct").cast("int").alias("correct"), *columns,
    ).withColumns({"id": F.col("id").cast("long"), "rating": F.col("rating").cast("double")})


def write_predictions(predictions: DataFrame, path: str) -> None:
    """One Parquet table partitioned by model and outcome, sorted by id inside each file."""
    (
        predictions.where("correct IS NOT NULL").hint("rebalance", "model", "correct").sortWithinPartitions("model", "correct", "id")
        .write.mode("overwrite").partitionBy("model", "correct").parquet(path)
    )


def write_prediction_files(predictions: DataFrame, folder: str, models: Sequence[str]) -> None:
    """CSV pairs ``correct_predictions_<model>.csv`` / ``wrong_predictions_<model>.csv``.

    Each is a directory of part files; texts without a prediction are left out.
    """
    for model in models:
        for flag, name in ((1, "correct"), (0, "wrong")):
            chosen = predictions.where((F.col("model") == model) & (F.col("correct") == flag))
            write_csv(chosen.drop("model", "correct").orderBy("id"), f"{folder}/{name}_predictions_{model}.csv")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
