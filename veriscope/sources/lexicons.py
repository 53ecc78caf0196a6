"""Word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.shared import settle


def read_concreteness(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated rating list with columns ``Word`` and ``Conc.M``, settled."""
    listed = spark.read.csv(path, sep="\t", header=True)
    return settle(
        listed.select(F.col("Word").alias("word"), F.col("`Conc.M`").try_cast("double").alias("concreteness"))
        .groupBy("word").agg(F.max("concreteness").alias("concreteness"))
    )


def stop_word_table(spark: SparkSession, stop_words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in stop_words], "word string")
