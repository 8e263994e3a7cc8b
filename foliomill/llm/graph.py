"""Connected components of a large graph, without collecting any of it."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them. Edges run from larger a to smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) for every node with an edge, root the smallest node of its component.

    edges: columns a, b of one orderable type. Alternates large-star and small-star steps (Kiveris et al.,
    2014), which keep components and end with a star around each smallest node; each round is written to
    the shared folder, until one changes nothing. Smallest neighbours are aggregated before they are shuffled, and a node with very many
    neighbours meets its minimum in a join that Spark can split.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = None
    for k in itertools.count():
        current = saved(_small_star(_large_star(current)), folder, f"{name}-{k}")
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
