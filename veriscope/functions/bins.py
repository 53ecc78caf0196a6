"""Interval bins: fixed edges and quantile edges, right-closed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.operators.quantiles import exact_quantiles

# Word-count intervals of the length report and their names; the last one is open.
LENGTH_EDGES = (0, 20, 50, 100, 200, 500, float("inf"))
LENGTH_LABELS = ("1–20", "21–50", "51–100", "101–200", "201–500", "500+")


def fixed_bin_no(value: Column, edges: Sequence[float] = LENGTH_EDGES) -> Column:
    """Number of the interval (low, high] that holds the value; NULL outside."""
    chosen = F.lit(None).cast("int")
    for number in range(len(edges) - 1, 0, -1):
        inside = (value > edges[number - 1]) & (value <= edges[number])
        chosen = F.when(inside, F.lit(number)).otherwise(chosen)
    return chosen


def bin_label(bin_no: Column, labels: Sequence[str] = LENGTH_LABELS) -> Column:
    chosen = F.lit(None).cast("string")
    for number, label in enumerate(labels, start=1):
        chosen = F.when(bin_no == number, F.lit(label)).otherwise(chosen)
    return chosen


def with_quantile_bins(df: DataFrame, value: str, bins: int = 5, unit: str = " Wörter") -> DataFrame:
    """Add ``bin_no`` and ``bin_label`` from quantile edges of ``value``.

    Equal edges are merged.  The edges come from one scalar subquery, so the row
    side is neither shuffled nor joined.  ``df`` is read twice: settle it first
    when it is expensive.
    """
    probs = [i / bins for i in range(bins + 1)]
    edges = (
        exact_quantiles(df, value, probs)
        .agg(F.array_sort(F.collect_set(F.round("quantile", 9))).alias("edges"))
    )
    inner_below = F.size(F.filter("edges", lambda e: e < F.col(value)))
    last_bin = F.greatest(F.size("edges") - 1, F.lit(1))
    binned = df.withColumn("edges", edges.scalar()).withColumn(
        "bin_no",
        F.when(F.col(value).isNotNull(), F.least(F.greatest(inner_below, F.lit(1)), last_bin)),
    )
    low = F.element_at("edges", F.col("bin_no"))
    # the lowest bin includes its left edge, so its label starts at that edge
    first = F.when(F.col("bin_no") == 1, F.floor(low - 0.001) + 1).otherwise(F.floor(low) + 1)
    high = F.floor(F.element_at("edges", F.least(F.col("bin_no") + 1, F.size("edges"))))
    label = F.when(
        F.col("bin_no").isNotNull(),
        F.concat(first.cast("string"), F.lit("–"), high.cast("string"), F.lit(unit)),
    )
    return binned.withColumn("bin_label", label).drop("edges")
