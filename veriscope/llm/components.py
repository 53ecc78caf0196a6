"""Connected components of a table of links.

Each round hangs every node below the smallest of its neighbours, first the larger ones
(large star), then the smaller ones (small star); the links that remain after the last round
are stars around the smallest node of each component.  Every round is an aggregation and a
join by node, which Spark splits where a node has very many links, and is settled in the
shared folder; the driver sees a count and a checksum only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.shared import settle


def _hung(links: DataFrame) -> DataFrame:
    """(u, v) with ``m``, the smallest of u and its neighbours."""
    smallest = links.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return links.join(smallest, "u")


def large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hung(both).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _hung(down)
    moved = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(hung.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``links`` (u, v).

    Nodes are of an orderable type without nulls; links may repeat and go either way.  A node
    without links to others is not listed.
    """
    current = settle(links.select("u", "v").where("u <> v").distinct())
    state = _state(current)
    while state[0]:
        current = settle(small_star(large_star(current)))
        if (now := _state(current)) == state:
            break
        state = now
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
