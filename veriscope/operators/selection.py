"""Reproducible samples, splits and row numbers, by hash of the key."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriscope.shared import broadcast_if_small, pinned, settle


def seeded_hash(key: str = "id", seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def first_rows(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    return df.orderBy(key).limit(n)


def seeded_sample(df: DataFrame, n: int, key: str = "id", seed: int = 42, check: bool = True) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash.

    Independent of partitioning, and a smaller sample is part of a larger one.
    """
    if check and len(df.select(key).take(n)) < n:
        raise ValueError(f"a sample of {n} rows needs at least {n} rows")
    return df.orderBy(seeded_hash(key, seed), key).limit(n)


def nested_samples(df: DataFrame, sizes: Sequence[int], key: str = "id", seed: int = 42) -> DataFrame:
    """Samples of several sizes in one table, told apart by ``sample_size``."""
    largest = seeded_sample(df, max(sizes), key, seed)
    # ranks only the rows of the largest sample
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(seeded_hash(key, seed), key))
    chosen = F.filter(F.array(*[F.lit(n) for n in sorted(sizes)]), lambda n: n >= F.col("rank"))
    return largest.withColumn("rank", rank).withColumn("sample_size", F.explode(chosen))


def split_quotas(counts: DataFrame, test_size: float, label: str = "label") -> DataFrame:
    """Rows per label to hold out: largest remainders, ``ceil(test_size * n)`` in total.

    ``counts`` has one row per label with its number of rows ``n``.  Integer arithmetic.
    """
    share = Fraction(str(test_size))
    num, den = F.lit(share.numerator), F.lit(share.denominator)
    whole = Window.partitionBy(F.lit(0))
    base = (F.col("n") * num - F.col("n") * num % den) / den
    wanted = F.ceil(F.sum("n").over(whole) * num / den)
    return (
        counts.withColumn("base", base.cast("long"))
        .withColumn("rest", F.col("n") * num % den)
        .withColumn("missing", wanted - F.sum("base").over(whole))
        .withColumn("turn", F.row_number().over(whole.orderBy(F.desc("rest"), label)))
        .select(label, "n", (F.col("base") + (F.col("turn") <= F.col("missing")).cast("long")).alias("quota"))
    )


def stratified_split(df: DataFrame, test_size: float = 0.2, label: str = "label", key: str = "id",
                     seed: int = 42) -> DataFrame:
    """Add ``part`` ('train' or 'test'): exact quota per label, stable under repartitioning.

    Counting rows per hash prefix finds the one prefix per label in which the quota is
    reached; only that prefix's rows are ordered, which gives the last hash of the test
    part.  All rows are then placed by comparing hashes: no label, however frequent, is
    ordered as a whole, and ``df`` itself is not shuffled.
    """
    keys = settle(df.select(key, label), compact=True)
    hashed = keys.withColumn("h", seeded_hash(key, seed)).withColumn("prefix", F.substring("h", 1, 4))
    # at most 65 536 prefixes per label
    histogram = hashed.groupBy(label, "prefix").agg(F.count("*").alias("n"))
    quotas = split_quotas(histogram.groupBy(label).agg(F.sum("n").alias("n")), test_size, label)
    running = Window.partitionBy(label).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    cut_prefixes = pinned(
        histogram.withColumn("upto", F.sum("n").over(running))
        .join(F.broadcast(quotas.select(F.col(label).alias("c_label"), "quota")),  # a row per label
              F.col(label).eqNullSafe(F.col("c_label")))
        .where((F.col("upto") - F.col("n") < F.col("quota")) & (F.col("quota") <= F.col("upto")))
        .select("c_label", F.col("prefix").alias("c_prefix"),
                (F.col("quota") - (F.col("upto") - F.col("n"))).alias("open"))
    )
    rank = F.row_number().over(Window.partitionBy(label).orderBy("h", key))
    last_test_rows = pinned(
        hashed.join(cut_prefixes,
                    F.col(label).eqNullSafe(F.col("c_label")) & (F.col("prefix") == F.col("c_prefix")))
        .withColumn("rank", rank)
        .where("rank = open")
        .select("c_label", F.col("h").alias("c_hash"), F.col(key).alias("c_key"))
    )
    h = seeded_hash(key, seed)
    is_test = (h < F.col("c_hash")) | ((h == F.col("c_hash")) & (F.col(key) <= F.col("c_key")))
    # a label with quota 0 has no last test row: all its rows train
    return (
        df.join(last_test_rows, F.col(label).eqNullSafe(F.col("c_label")), "left")
        .withColumn("part", F.when(is_test, "test").otherwise("train"))
        .drop("c_label", "c_hash", "c_key")
    )


def hash_fraction(key: str = "id", seed: int = 42) -> Column:
    """A reproducible number in [0, 1) per row."""
    return F.conv(F.substring(seeded_hash(key, seed), 1, 13), 16, 10).cast("double") / float(16 ** 13)


def holdout_split(df: DataFrame, test_size: float = 0.2, key: str = "id", seed: int = 42) -> DataFrame:
    """Add ``part`` by hash alone: unstratified, approximate size, no shuffle."""
    return df.withColumn("part", F.when(hash_fraction(key, seed) < test_size, "test").otherwise("train"))


def fold_no(folds: int, key: str = "id", seed: int = 42) -> Column:
    return F.floor(hash_fraction(key, seed) * folds).cast("int")


def _file_order(path: Column) -> list[Column]:
    """Sorts part files by their number, others by name."""
    return [F.regexp_replace(path, r"part-\d+.*$", ""), F.regexp_extract(path, r"part-(\d+)", 1).try_cast("long"), path]


def number_rows(stored: DataFrame, name: str = "id", first: int = 1, source: str | None = None) -> DataFrame:
    """Consecutive ids in file order for a Parquet-backed table.

    With ``source``, a column that names the file each row was imported from, rows are
    numbered in the order of those files and inside them.  A row's place comes from the
    Parquet file itself, so only one count per file is aggregated and no row moves.
    """
    parquet = F.col("_metadata.file_path")
    placed = stored.withColumns({"_parquet": parquet, "_row": F.col("_metadata.row_index")})
    origin = F.col(source) if source else parquet
    sizes = stored.select(origin.alias("_origin"), parquet.alias("_parquet"), F.col("_metadata.row_index").alias("_row")).groupBy(
        "_origin", "_parquet").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(  # a row per file
        *_file_order(F.col("_origin")), *_file_order(F.col("_parquet"))).rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(sizes.select("_origin", "_parquet", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset")))
    return (
        placed.withColumn("_origin", origin).join(broadcast_if_small(offsets), ["_origin", "_parquet"])
        .withColumn(name, F.col("_offset") + F.col("_row") + first)
        .drop("_parquet", "_row", "_offset", "_origin")
    )
