"""Exact quantiles that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriscope.shared import pinned


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Linearly interpolated quantiles: one row (``by``…, prob, quantile) per group and prob.

    ``percentile``/``median`` keep every distinct value of a group in one buffer.
    Here a mergeable sketch brackets each quantile first; then everything below a
    bracket is only counted, and only the few values inside it are ordered.
    ``df`` is read twice: settle it first when it is expensive.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    margin = 20.0 / accuracy
    floor_probs = [max(p - margin, 0.0) for p in probs]
    ceiling_probs = [min(p + margin, 1.0) for p in probs]
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.percentile_approx("v", floor_probs, accuracy).alias("lows"),
        F.percentile_approx("v", ceiling_probs, accuracy).alias("highs"),
    )
    # The sketch's rank error is n / accuracy, far inside the margin once n > accuracy;
    # a smaller group is ordered whole.
    targets = F.array(*[
        F.struct(
            F.lit(float(p)).alias("prob"),
            F.when((F.col("n") <= accuracy) | F.lit(floor_probs[i] == 0.0), F.col("least"))
            .otherwise(F.col("lows")[i]).alias("low"),
            F.when((F.col("n") <= accuracy) | F.lit(ceiling_probs[i] == 1.0), F.col("most"))
            .otherwise(F.col("highs")[i]).alias("high"),
        )
        for i, p in enumerate(probs)
    ])
    if by:
        group_targets = pinned(
            sketch.select(*[F.col(c).alias(f"g_{c}") for c in by], "n", targets.alias("targets"))
        )
        same_group = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in by]
        paired = rows.join(group_targets, same_group)
    else:
        whole = sketch.select(F.struct("n", targets.alias("targets")).alias("s")).scalar()
        paired = rows.withColumn("s", whole).select("v", "s.n", "s.targets")
    reached = F.filter("targets", lambda t: t["high"] >= F.col("v"))
    counted = (
        paired.select(*by, "v", "n", F.explode(reached).alias("t"))
        .groupBy(*by, F.col("t.prob").alias("prob"),
                 F.when(F.col("v") >= F.col("t.low"), F.col("v")).alias("key"))
        .agg(F.count("*").alias("cnt"), F.max("n").alias("n"))
    )
    ordered = Window.partitionBy(*by, "prob").orderBy(F.col("key").asc_nulls_first())
    ranked = counted.withColumn(
        "upto", F.sum("cnt").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("before", F.col("upto") - F.col("cnt"))
    position = F.col("prob") * (F.col("n") - 1)

    def value_at(rank):
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("upto")), F.col("key")))

    return (
        ranked.groupBy(*by, "prob")
        .agg(
            value_at(F.floor(position)).alias("left"),
            value_at(F.ceil(position)).alias("right"),
            F.max(position - F.floor(position)).alias("part"),
        )
        .select(
            *by, "prob",
            (F.col("left") + (F.col("right") - F.col("left")) * F.col("part")).alias("quantile"),
        )
    )
