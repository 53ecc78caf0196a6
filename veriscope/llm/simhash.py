"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments.  Of two fingerprints that differ in at
most two bits, one segment differs in at most one.  So each segment is indexed in 32
variants, each with another bit as a wildcard; fingerprints that share a variant are joined
and their distance verified.  A pair is reported by the first variant only that it shares.

A variant that very many different fingerprints share is not joined with itself: its rows
get a second key, a variant of the other segment, so that all that share both keys are
within the distance; each is linked with the smallest of them, and no pairs are made.

Cases: a null text is an empty one; a text without words has fingerprint zero, linked like
any other; fewer words than a shingle are one shingle; equal texts share a fingerprint and
meet before the index; a null doc_id never names a component unless all of it are null;
repeated rows are in the same component; further columns are ignored; an empty table stays
empty.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.llm.components import components
from veriscope.llm.row_keys import keyed, marked
from veriscope.llm.texts import has_columns, let, run_of, words
from veriscope.shared import broadcast_if_small, settle

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEGMENT_BITS = 32
JOINED_ROWS = 256  # a variant of more fingerprints gets a second key
SLICE = 1 << 16


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """XXH64 with seed 42 of every shingle, repeats included; none for a text without words."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)

    def hashes(found: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(found) - size, F.lit(0)))
        # places beyond a short text are null and left out
        each = F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", *run_of(found, i, size))))
        return F.when(F.size(found) > 0, each).otherwise(F.array().cast("array<bigint>"))

    return let(words(lowered), hashes)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        octets = np.ascontiguousarray(hashes[at:at + SLICE], dtype="<i8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, size: int = SHINGLE_WORDS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``fp`` of every row; the shingles are hashed by Spark, their bits counted in numpy."""
    hashed = df.select(*keys, shingle_hashes(F.col("text"), size).alias("hashes"))

    def counted(batches):
        for batch in batches:
            found = [majority_bits(hashes.values.to_numpy()) for hashes in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], pa.array(found, pa.int64())], names=[*keys, "fp"])

    kept = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return hashed.mapInArrow(counted, f"{kept}, fp long")


def fingerprint_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def segment(value: Column | str, no: Column | int) -> Column:
    """Segment 0 (the low bits) or 1 of a fingerprint, as a number."""
    value = F.col(value) if isinstance(value, str) else value
    low, high = value.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(value, SEGMENT_BITS)
    return (high if no else low) if isinstance(no, int) else F.when(no == 0, low).otherwise(high)


def without_bit(value: Column, bit: Column) -> Column:
    power = F.element_at(F.array(*[F.lit(1 << b) for b in range(SEGMENT_BITS)]), (bit + 1).cast("int"))
    return value.bitwiseAND(F.bitwise_not(power))


def variants(fingerprints: DataFrame) -> DataFrame:
    """``slot`` (segment and wildcard), ``rest`` (the segment without the wildcard), ``fp``."""
    placed = fingerprints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT_BITS - 1))).alias("slot"))
    part = segment("fp", F.floor(F.col("slot") / SEGMENT_BITS))
    return placed.select("slot", without_bit(part, F.col("slot") % SEGMENT_BITS).alias("rest"), "fp")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def joined_links(shared: DataFrame) -> DataFrame:
    """Pairs within the distance, each from the first slot in which it shares a variant."""
    left = shared.select("slot", "rest", F.col("fp").alias("u"))
    right = shared.select("slot", "rest", F.col("fp").alias("v"))
    low = segment(F.col("u").bitwiseXOR(F.col("v")), 0)
    first_slot = F.when(low == 0, 0).when(F.bit_count(low) == 1, F.bit_count(low - 1)).otherwise(SEGMENT_BITS)
    near = (F.col("u") < F.col("v")) & (distance(F.col("u"), F.col("v")) <= MAX_DISTANCE)
    return left.join(right, ["slot", "rest"]).where(near & (F.col("slot") == first_slot)).select("u", "v")


def second_keys(crowded: DataFrame) -> DataFrame:
    """Second keys of rows in crowded variants: all rows with equal keys are within the distance.

    If the first segments may differ in their wildcard, the second ones may in one bit; of
    fingerprints whose first segments are equal, the second ones may differ in two.
    """
    no = F.floor(F.col("slot") / SEGMENT_BITS)
    own, other = segment("fp", no), segment("fp", 1 - no)
    one = crowded.select("fp", "slot", F.col("rest").alias("first"), other.alias("_other"), F.explode(
        F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1))).alias("wild"))
    one = one.select("fp", "slot", "first", F.col("wild").cast("int"), without_bit(F.col("_other"), F.col("wild")).alias("second"))
    pairs = F.array(*[F.lit(a * SEGMENT_BITS + b) for a in range(SEGMENT_BITS) for b in range(a + 1, SEGMENT_BITS)])
    two = crowded.where(F.col("slot") % SEGMENT_BITS == 0).select(
        "fp", (F.col("slot") - 2 * SEGMENT_BITS).alias("slot"), own.alias("first"), other.alias("_other"),
        F.explode(pairs).alias("wild"))
    second = without_bit(without_bit(F.col("_other"), F.floor(F.col("wild") / SEGMENT_BITS)), F.col("wild") % SEGMENT_BITS)
    return one.unionByName(two.select("fp", "slot", "first", "wild", second.alias("second")))


def starred_links(crowded: DataFrame) -> DataFrame:
    """Each row's link with the smallest fingerprint that shares both keys."""
    keys = ["slot", "first", "wild", "second"]
    keyed = second_keys(crowded)
    smallest = keyed.groupBy(*keys).agg(F.min("fp").alias("v"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return keyed.join(smallest, keys).where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def variant_counts(fingerprints: DataFrame) -> DataFrame:
    """``slot``, ``rest`` and the number ``n`` of fingerprints of every shared variant, counted before the shuffle."""
    return variants(fingerprints).groupBy("slot", "rest").agg(F.count("*").alias("n")).where("n > 1")


def fingerprint_links(fingerprints: DataFrame, joined_rows: int = JOINED_ROWS) -> DataFrame:
    """Links (u, v) that connect all different fingerprints within the distance."""
    counts = broadcast_if_small(settle(variant_counts(fingerprints), compact=True))
    shared = settle(variants(fingerprints).join(counts, ["slot", "rest"]), compact=True)
    joined = joined_links(shared.where(F.col("n") <= joined_rows))
    return joined.unionByName(starred_links(shared.where(F.col("n") > joined_rows)))


def grouped(rows: DataFrame, joined_rows: int = JOINED_ROWS) -> DataFrame:
    """``fp``, ``root`` (the smallest fingerprint reachable) and ``component_id`` of all
    fingerprints of settled rows (doc_id, fp)."""
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(fingerprint_links(distinct.select("fp"), joined_rows))
    # only fingerprints with links have a component of their own
    linked = found.join(distinct, found["node"] == distinct["fp"]).select("fp", "component", "first_id")
    smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(smallest, "component").select("fp", F.col("component").alias("root"), "component_id")
    return settle(distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id")))


def near_duplicates(df: DataFrame, size: int = SHINGLE_WORDS, joined_rows: int = JOINED_ROWS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the smallest doc_id reachable) of every row."""
    has_columns(df, "doc_id", "text")
    rows = settle(fingerprints(df, size), compact=True)
    return rows.join(grouped(rows, joined_rows).drop("root"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(df: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row of every component: the one with the smallest doc_id; of several with that doc_id,
    the one whose text has the smallest hash.  Rows without doc_id stay.

    Rows are chosen by their place in the table, so that texts stay where they are.
    """
    has_columns(df, "doc_id", "text")
    rows = keyed(df)
    texts = rows.select("_row", "_given.doc_id", "_given.text", F.xxhash64("_given.text").alias("digest"))
    prints = settle(fingerprints(texts, size, ("_row", "doc_id", "digest")), compact=True)
    order = F.struct("doc_id", "digest", "_row")
    first = prints.where("doc_id IS NOT NULL").join(grouped(prints).select("fp", "root"), "fp").groupBy("root").agg(
        F.min(order).alias("first"))
    return marked(rows, first.select("first._row"), "_first").where("_first OR _given.doc_id IS NULL").select("_given.*")


def op6_simhash(spark, sf_dir):
    """Every document with its fingerprint and its component."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(documents).select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")
