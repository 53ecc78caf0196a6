"""The given tables in the shape of the audited corpus.

``documents`` are the texts (the source stands for the category, the rating is made
from the length), ``labels`` the classes, ``embeddings`` vectors and class scores.
Three fixed rules play the classifiers, so that every engine predicts the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.functions.text import words
from veriscope.operators.consolidate import consolidate, long_predictions
from veriscope.shared import shared_folder
from veriscope.sources.store import materialize

MODELS = ("rule_length", "rule_variety", "rule_punct")
LABELS = ("CG", "OR")
# Fixed values of the fixture.
STOP_WORDS = ("the", "of", "de", "and", "to", "in", "la", "der", "is", "that", "en", "for", "it", "on")
SUPERLATIVES = ("the", "that", "and", "there")
NEGATORS = ("not", "no", "la", "in")
PUNCTUATION = r"[^\p{L}\p{N}\s]"
BASE = ("category", "rating", "label")
# A session may name the number of tasks that texts are dealt to as they are read: Spark does not
# split a row group, so that a file of one is one task.  Tables of many row groups need none.
SPREAD = "spark.veriscope.spread"
TASK_BYTES = 8 * 1024 * 1024  # of text, measured by one task


def documents(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    """All texts: id, category, rating, text_; dealt to ``spread`` tasks, if given or set in the session."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("source").alias("category"),
        (1 + F.col("n_chars") % 5).cast("double").alias("rating"), F.col("text").alias("text_"),
    )
    spread = spread or int(spark.conf.get(SPREAD, "0"))
    return texts.repartition(spread) if spread else texts


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in tasks of bounded size, for work that takes long by character.

    Files are read by row groups; if one task would read more than ``TASK_BYTES`` of text, all texts
    are dealt out by id.  One pass over the texts finds the largest task.
    """
    texts = documents(spark, sf_dir)
    read = texts.select(F.spark_partition_id().alias("task"), F.octet_length("text_").cast("long").alias("n"))
    largest, total = read.groupBy("task").agg(F.sum("n").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return texts.repartition(-(-total // TASK_BYTES), "id") if (largest or 0) > TASK_BYTES else texts


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], *tables: str) -> DataFrame:
    """What several audits read, built once as long as the given tables stay as they are."""
    return materialize(spark, shared_folder(spark), f"veriscope-{name}", build, {}, [f"{sf_dir}/{t}.parquet" for t in tables])


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "OR").otherwise("CG").alias("label")
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled texts."""
    return documents(spark, sf_dir).join(labels(spark, sf_dir), "id")


def measured(texts: DataFrame) -> DataFrame:
    """The numbers the rules look at, instead of the text."""
    text = F.col("text_")
    return texts.withColumns({
        "lw": words(F.lower(text)), "cl": F.length(text), "pu": F.regexp_count(text, F.lit(PUNCTUATION)),
    }).withColumns({"wl": F.size("lw"), "uq": F.size(F.array_distinct("lw"))}).drop("lw", "text_")


def joined_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts by their numbers: measured before the join, so no text is shuffled."""
    return measured(dealt(spark, sf_dir)).join(labels(spark, sf_dir), "id")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, stored: texts are read by the first audit of a session only."""
    return stored(spark, sf_dir, "facts", lambda: joined_facts(spark, sf_dir), "documents", "labels")


def rules() -> dict[str, Column]:
    def verdict(genuine):
        return F.when(genuine, "OR").otherwise("CG")

    return {
        "rule_length": verdict(F.col("wl") >= 250),
        "rule_variety": verdict(F.col("uq") * 100 >= F.col("wl") * 78),
        "rule_punct": verdict(F.col("pu") * 1000 < F.col("cl") * 24),
    }


def predictions(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    """Long table (id, carry…, label, model, predicted_label, correct)."""
    return long_predictions(facts(spark, sf_dir), rules(), ["id", *carry, "label"])


def wide(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    """One row per labelled text with a 0/1 column per model."""
    columns = [c for c in BASE if c not in carry]
    return consolidate(predictions(spark, sf_dir, "category", "rating", *carry), MODELS, [*columns, *carry])


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word scores for the short plain words of the texts, stored."""
    found = F.explode(F.array_distinct(words(F.lower("text_")))).alias("word")  # then chosen: a lambda is interpreted for every word
    code, size = F.ascii("word"), F.length("word")
    return stored(spark, sf_dir, "lexicon", lambda: dealt(spark, sf_dir).select(
        found).where(F.col("word").rlike(r"\A[a-z]{2,6}\z")).distinct().select(
        "word",
        (1 + ((code * 31 + size * 7) % 401) / 100.0).alias("concreteness"),
        (((code * 17 + size * 5) % 201 - 100) / 100.0).alias("polarity"),
        F.when((code + size) % 3 == 0, "ADJ").when((code + size) % 3 == 1, "NOUN").otherwise("OTHER").alias("pos"),
    ), "documents")


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, for comparison across engines."""
    return df.withColumns({
        f.name: F.round(f.name, digits)
        for f in df.schema.fields if f.dataType.typeName() == "double" and f.name not in keep
    })
