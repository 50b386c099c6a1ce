"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialise


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _apart(least: DataFrame) -> DataFrame:
    """least, dealt anew, so that its join by u has a shuffle of its own: such a join is split where a node has very many
    neighbours, one that stands on an aggregate by the same key is not. (Dealing by u itself would be optimized away.)"""
    return least.repartition(F.xxhash64("u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(_apart(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(_apart(least), "u").where("v <> m")
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u long, v long)`` except the roots themselves.

    root is the smallest node reachable. Every round writes its edges to the shared folder;
    the driver sees only their count and a checksum. A node with very many neighbours is
    only ever minimised (combined map-side) and joined (both sides behind shuffles of their own, so that AQE splits it).
    """
    now = materialise(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    seen = _mark(now)
    while seen[0]:
        # a large star leaves u > v, as its minimum is at most u
        now = materialise(_small_star(_large_star(now).distinct()).distinct(), "edges")
        before, seen = seen, _mark(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
