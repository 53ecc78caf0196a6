"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are chosen from a bounded sample.  A vector is described by its
nearest pivots in order; vectors that share at least ``SHARED`` of them are compared.  They
are found through inverted lists, one per combination of ``SHARED`` pivots; a pair is
compared in the first list that it shares only.  A long list is dealt into tiles that are
compared two by two, so that no task holds a list; a task reports how much each vector
links with and a star per group of linked vectors, never the pairs.

The description is approximate.  How many pivots there are, how many a vector is described by
and must share, and whether the sample's mean is taken off first, is chosen by what the sample
shows: pairs at the limit are made from its vectors, and of the settings in which enough of
them share a list, the one is taken in which the fewest other pairs do.  What is reported is
verified in double precision.

Cases: vectors that are null, empty, zero or hold null or non-finite components, or have no
label, link with nothing; vectors of different length never link; equal vectors are one
class, whose rows link with each other and share all links; repeated rows are vectors of
their own; a null vec_id names no component unless all of it are null; further columns are
ignored; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.components import components
from veriscope.llm.texts import has_columns
from veriscope.shared import broadcast_if_small, settle

LIMIT = 0.93
PIVOTS, SAMPLE_ROWS = 128, 4096
NEAREST, SHARED = 6, 2
RECALL, PLANTED_PAIRS = 0.95, 1000  # share of pairs at the limit that must share a list; how many are made
# Pivots, nearest ones and shared ones to choose from.
SETTINGS = ((128, 6, 2), (128, 8, 2), (128, 12, 2), (64, 8, 2), (64, 12, 2), (32, 8, 2), (32, 12, 2), (16, 8, 2), (16, 6, 1), (8, 4, 1), (4, 3, 1), (1, 1, 1))
TILE_ROWS = 1024
PAIR_ROWS = 1 << 18  # pairs looked at together


def vector_classes(vectors: DataFrame) -> DataFrame:
    """Equal vectors with equal labels: ``label``, ``embedding``, ``first_id``, ``copies``."""
    usable = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    nonzero = F.exists("embedding", lambda x: x != 0)
    return vectors.where(F.col("label").isNotNull() & usable & nonzero).groupBy("label", "embedding").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares stay finite."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def chosen_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Points of the sample, each the one least similar to those before."""
    points = unit(sample)
    chosen, nearest = [0], points @ points[0]
    while len(chosen) < min(n, len(points)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    return points[chosen]


@dataclass(frozen=True)
class Index:
    """How vectors of one length are described."""

    pivots: np.ndarray
    nearest: int = NEAREST
    shared: int = SHARED
    centre: np.ndarray | None = None
    recall: float | None = None  # of made pairs, where it was measured

    def points(self, rows: np.ndarray) -> np.ndarray:
        return rows if self.centre is None else rows - self.centre

    def near(self, rows: np.ndarray) -> np.ndarray:
        return nearest_pivots(self.points(rows), self.pivots, self.nearest)


def pairs_at_the_limit(points: np.ndarray, limit: float, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors and others at the limit from them: turned anywhere, and turned towards other vectors."""
    draw = np.random.default_rng(seed)
    own = points[draw.choice(len(points), min(PLANTED_PAIRS, len(points)), replace=False)]
    found = []
    for towards in (draw.normal(size=own.shape), points[draw.integers(0, len(points), len(own))] + 1e-6 * draw.normal(size=own.shape)):
        across = towards - (towards * own).sum(axis=1, keepdims=True) * own
        across /= np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-300)
        found.append((own, limit * own + np.sqrt(max(0.0, 1 - limit * limit)) * across))
    return found


def share_of_pairs(index: Index, a: np.ndarray, b: np.ndarray) -> float:
    """How many pairs share a list."""
    common = (index.near(a)[:, :, None] == index.near(b)[:, None, :]).any(axis=2).sum(axis=1)
    return float((common >= min(index.shared, len(index.pivots))).mean())


def chosen_index(sample: np.ndarray, limit: float = LIMIT, recall: float = RECALL) -> Index:
    """The setting with the fewest other pairs in its lists of those that reach ``recall``; else the one that finds most."""
    points = unit(sample)
    mean = points.mean(axis=0)
    made = pairs_at_the_limit(points, limit)
    draw = np.random.default_rng(1)
    others = points[draw.integers(0, len(points), 2 * PLANTED_PAIRS)].reshape(2, PLANTED_PAIRS, -1)
    tried = []
    for centre in (None, mean):
        placed = points if centre is None else points - centre
        far = chosen_pivots(np.where(np.abs(placed).max(axis=1, keepdims=True) > 0, placed, 1.0), max(s[0] for s in SETTINGS))
        for pivots, nearest, shared in SETTINGS:
            index = Index(far[:pivots], nearest, shared, centre)
            found = min(share_of_pairs(index, a, b) for a, b in made)
            tried.append((Index(far[:pivots], nearest, shared, centre, found), found, share_of_pairs(index, *others)))
    enough = [t for t in tried if t[1] >= recall]
    return min(enough, key=lambda t: t[2])[0] if enough else max(tried, key=lambda t: t[1])[0]


def fitted_indexes(classes: DataFrame, limit: float = LIMIT, sample_rows: int = SAMPLE_ROWS, fixed: tuple[int, int, int] | None = None) -> dict[int, Index]:
    """An index by vector length; at most ``sample_rows`` vectors of each of the 16 most
    frequent lengths reach the driver.  Other lengths use a single pivot each.

    ``fixed`` (pivots, nearest, shared) leaves nothing to choose.
    """
    by_length = classes.withColumn("_length", F.size("embedding"))
    frequent = by_length.groupBy("_length").count().orderBy(F.desc("count"), "_length").limit(16).collect()
    found = {}
    for row in frequent:
        sample = (
            by_length.where(F.col("_length") == row["_length"])
            .orderBy(F.xxhash64("label", "embedding"), "class").limit(sample_rows).select("embedding").toArrow()
        )
        vectors = _matrix(sample.column(0).combine_chunks(), row["_length"])
        found[row["_length"]] = Index(chosen_pivots(vectors, fixed[0]), *fixed[1:]) if fixed else chosen_index(vectors, limit)
    return found


def _matrix(column, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def nearest_pivots(points: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """The numbers of the nearest pivots of each row, nearest first."""
    nearest = min(nearest, len(pivots))
    similar = points @ pivots.T
    some = np.argpartition(-similar, nearest - 1, axis=1)[:, :nearest]
    order = np.argsort(-np.take_along_axis(similar, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


POSTING = "label {label}, length int, list long, class long, copies long, near array<int>, embedding array<{element}>"


def postings(classes: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """A row for every combination of as many of a vector's nearest pivots as must be shared."""
    described = classes.select("label", F.size("embedding").alias("length"), "class", "copies", "embedding")

    def describe(batches):
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                own = indexes.get(int(length))
                points = unit(_matrix(part.column(4), int(length)))
                near = own.near(points) if own is not None else np.zeros((len(points), 1), dtype=np.int64)
                shared = own.shared if own is not None else 1
                near_list = pa.FixedSizeListArray.from_arrays(pa.array(near.astype(np.int32).ravel()), near.shape[1]).cast(
                    pa.list_(pa.int32()))
                ordered = np.sort(near, axis=1)
                for places in combinations(range(near.shape[1]), min(shared, near.shape[1])):
                    key = np.zeros(len(points), dtype=np.int64)
                    for p in places:
                        key = (key << 16) + ordered[:, p]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(key), part.column(2), part.column(3), near_list, part.column(4)],
                        names=["label", "length", "list", "class", "copies", "near", "embedding"])

    kinds = {"label": classes.schema["label"].dataType.simpleString(),
             "element": classes.schema["embedding"].dataType.elementType.simpleString()}
    return described.mapInArrow(describe, POSTING.format(**kinds))


def tiled(posted: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The rows of every list with at least two, dealt to pairs of tiles (``a`` <= ``b``)."""
    lists = ["label", "length", "list"]
    counts = settle(posted.groupBy(*lists).agg(F.count("*").alias("_n")).where("_n > 1"), compact=True)
    long = broadcast_if_small(counts)
    tiles = F.ceil(F.col("_n") / tile_rows).cast("long")
    own = posted.join(long, lists).withColumn("_tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("class"), "_tiles"))
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
    return other.withColumns({"a": F.least("tile", "_other"), "b": F.greatest("tile", "_other")}).drop("_n", "_tiles", "_other")


def groups(batches, key_columns: int):
    """The runs of equal keys (the first columns) of sorted batches, as record batches of two rows or more."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest, batch]).combine_chunks()
        if not table.num_rows:
            continue
        changes = np.zeros(table.num_rows - 1, dtype=bool)
        for i in range(key_columns):
            values = table.column(i).to_numpy()
            changes |= values[1:] != values[:-1]
        edges = np.flatnonzero(np.concatenate([[True], changes]))
        for start, end in zip(edges, edges[1:]):
            if end - start > 1:
                yield table.slice(start, end - start)
        rest = table.slice(edges[-1]).to_batches()
    if rest and sum(b.num_rows for b in rest) > 1:
        yield pa.Table.from_batches(rest).combine_chunks()


def linked_pairs(points: np.ndarray, near: np.ndarray, key: int, cross: np.ndarray | None, shared: int, limit: float):
    """Pairs of rows (i < j) at the limit or above that have this list as their first one.

    ``cross`` marks the rows of one of two different tiles: only pairs across are looked at.
    """
    last = key & 0xFFFF
    step = max(1, PAIR_ROWS // len(points))
    for start in range(0, len(points), step):
        similar = points[start:start + step] @ points.T
        i, j = np.nonzero(similar >= limit)
        i += start
        fits = (i < j) if cross is None else cross[i] & ~cross[j]
        i, j = i[fits], j[fits]
        common = (near[i][:, :, None] == near[j][:, None, :]).any(axis=2)
        first = (common & (near[i] <= last)).sum(axis=1) == min(shared, near.shape[1])
        yield i[first], j[first]


def star_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches."""
    labels = np.arange(n)
    while True:
        before = labels.copy()
        np.minimum.at(labels, i, before[j])
        np.minimum.at(labels, j, before[i])
        labels = labels[labels]
        if (labels == before).all():
            return labels


def class_links(dealt: DataFrame, indexes: dict[int, Index], limit: float = LIMIT) -> DataFrame:
    """Per class ``u``: ``n``, the vectors it links with as far as a tile pair shows, and a
    class ``v`` that it reaches there."""
    keys = ("length", "list", "a", "b")
    ordered = dealt.select("label", *keys, "tile", "class", "copies", "near", "embedding")
    # labels by number, so that runs can be told apart without comparing other types
    ordered = ordered.withColumn("label", F.xxhash64("label")).repartition("label", *keys).sortWithinPartitions("label", *keys, "class")

    def link(batches):
        for group in groups(batches, 5):
            length, key, a, b = (group.column(c)[0].as_py() for c in range(1, 5))
            copies, names = group.column(7).to_numpy(), group.column(6).to_numpy()
            near = _matrix(group.column(8), len(group.column(8)[0]))
            shared = indexes[length].shared if length in indexes else 1
            cross = None if a == b else group.column(5).to_numpy() == a
            pairs = [*linked_pairs(unit(_matrix(group.column(9), length)), near, key, cross, shared, limit)]
            i, j = (np.concatenate([p[side] for p in pairs]) for side in (0, 1))
            if not len(i):
                continue
            n = np.bincount(i, copies[j], len(names)) + np.bincount(j, copies[i], len(names))
            labels = star_labels(len(names), i, j)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[some]), pa.array(names[labels[some]]), pa.array(n[some].astype(np.int64))], names=["u", "v", "n"])

    return ordered.mapInArrow(link, "u long, v long, n long")


def near_duplicates(df: DataFrame, limit: float = LIMIT, n_pivots: int | None = None, nearest: int = NEAREST,
                    shared: int = SHARED, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``vec_id``, ``n_links`` (other vectors linked directly), ``component_id``, ``kept`` of every row.

    With ``n_pivots``, the index is not chosen by the sample.
    """
    has_columns(df, "vec_id", "embedding", "label")
    vectors = df.select("vec_id", "embedding", "label")
    classes = settle(vector_classes(vectors).withColumn("class", F.monotonically_increasing_id()))
    indexes = fitted_indexes(classes, limit, fixed=(n_pivots, nearest, shared) if n_pivots else None)
    dealt = tiled(postings(classes, indexes), tile_rows)
    links = settle(class_links(dealt, indexes, limit), compact=True)
    counts = links.groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("others"))
    found = components(links.select("u", "v"))
    members = found.join(classes.select(F.col("class").alias("node"), "first_id"), "node")
    names = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = members.join(names, "component").select(F.col("node").alias("class"), "component_id")
    known = (
        classes.join(counts, "class", "left").join(named, "class", "left")
        .select("label", "embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                F.coalesce("component_id", "first_id").alias("component_id"))
    )
    result = vectors.join(known, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark, sf_dir):
    """Every vector with its links and its component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
