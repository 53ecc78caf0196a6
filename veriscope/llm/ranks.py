"""Running totals and row numbers inside groups of any size.

A group is dealt into as many buckets as the square root of the number of rows.  Rows are
ordered inside their bucket, buckets inside their group, so that no task gets a whole group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_RANGE = 1 << 31
MIXER = 48_271


def bucket_count(rows: int) -> int:
    return max(1, math.isqrt(max(0, rows - 1)) + 1)


def running_totals(df: DataFrame, group: str, place: Column, value: Column, order: list[str], rows: int,
                   name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of ``group`` before this one.

    Rows are ordered by ``place`` (at least 0, below ``HASH_RANGE``), then ``order``; the
    result does not depend on the number of buckets.  ``df`` should be settled: it is read
    twice.
    """
    buckets = bucket_count(rows)
    dealt = df.withColumns({"_place": place, "_value": value}).withColumn(
        "_bucket", F.floor(F.col("_place") * buckets / float(HASH_RANGE)).cast("long"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(group, "_bucket").agg(F.sum("_value").alias("_sum")).select(
        F.col(group).alias("_group"), F.col("_bucket").alias("_at"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(group, "_bucket").orderBy("_place", *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_at")))
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_place", "_value", "_bucket", "_inside", "_group", "_at", "_start")
    )
