"""Document vectors, their projection, and batched models supplied by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from veriscope.functions.stats import star_rating
from veriscope.functions.text import filled, terms
from veriscope.learning.pca import Projection, fit_components, project_on


def hashed_word_vectors(texts: DataFrame, size: int = 64, text: str = "text_", output: str = "embedding") -> DataFrame:
    """Averaged word directions as document vectors; NULL for a text without words.

    Every word has a signed place among ``size``, by its hash: no vocabulary is fitted, held
    on the driver or cut, and a text's vector depends on the text alone.
    """
    digest = lambda word: F.md5(word)  # noqa: E731  a hash that other engines have, too
    number = lambda word: F.conv(F.substring(digest(word), 1, 8), 16, 10).cast("long")
    # place 1..size, negative for half of the words
    signed = lambda n: F.when(n % 2 == 0, 1).otherwise(-1) * (F.floor(n / 2) % size + 1)
    placed = texts.withColumn("_places", F.transform(terms(F.col(text)), lambda word: signed(number(word))))
    sums = F.aggregate(
        "_places", F.array_repeat(F.lit(0).cast("long"), size),
        lambda acc, p: F.transform(acc, lambda x, i: F.when(i == F.abs(p) - 1, x + F.sign(p).cast("long")).otherwise(x)),
    )
    means = F.transform(sums, lambda x: x / F.size("_places"))
    return placed.withColumn(output, F.when(F.size("_places") > 0, means)).drop("_places")


def encode(texts: DataFrame, make_encoder: Callable, batch: int = 512, text: str = "text_",
           output: str = "embedding") -> DataFrame:
    """Vectors from a supplied encoder.

    ``make_encoder()`` loads the model once per Python worker and returns a function
    from an array of texts to a matrix with one row per text.  Settle the result
    before using it twice.
    """
    run = predict_batch_udf(make_encoder, return_type=ArrayType(FloatType()), batch_size=batch)
    return texts.withColumn(output, run(filled(F.col(text))))


def star_sentiment(texts: DataFrame, make_scorer: Callable, batch: int = 32, text: str = "text_") -> DataFrame:
    """Stars 1..5 and confidence from a supplied five-class scorer that returns class scores."""
    scored = encode(texts, make_scorer, batch, text, "_scores").withColumn(
        "_scores", F.col("_scores").cast("array<double>")
    )
    stars, confidence = star_rating(F.col("_scores"))
    return scored.withColumns({"stars": stars, "confidence": confidence}).drop("_scores")


def annotate(texts: DataFrame, make_annotator: Callable, measures: Sequence[str], text: str = "text_",
             key: str = "id") -> DataFrame:
    """Numbers per text from a supplied annotator (a tagger, an entity recogniser).

    ``make_annotator()`` runs once per task and returns a function from one text to a
    dict with the listed measures.
    """
    names = list(measures)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        annotator = make_annotator()
        for batch in batches:
            found = pd.DataFrame([annotator(t) for t in batch["_text"]], columns=names, dtype="float64")
            found.insert(0, key, batch[key].to_numpy())
            yield found

    schema = f"{key} long, " + ", ".join(f"{name} double" for name in names)
    return texts.select(key, filled(F.col(text)).alias("_text")).mapInPandas(run, schema)


def fit_projection(vectors: DataFrame, dimensions: int = 2, column: str = "embedding") -> Projection:
    """Centred principal components of an array column."""
    return fit_components(vectors, dimensions, column)


def project(model: Projection, vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Add ``components`` as an array column."""
    return project_on(model, vectors, column)


def explained_variance(model: Projection) -> list[float]:
    return model.shares.tolist()
