"""Connected components by alternating large-star and small-star rounds; links never leave the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches over the links of one task."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a set of edges: equal marks mean that a round changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _starred(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hangs the neighbours of every node to the smallest of them. Both sides aggregate before they meet, so a
    hot node is one aggregated row joined to rows that Spark may split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = edges.join(least, "u")
    if larger_only:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges(u, v)`` but the smallest of each component; label is that smallest node.

    Edges with a null end or from a node to itself are ignored; repeats and both directions are allowed.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpointed(e)
    before = _mark(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both, True)
        e = checkpointed(_starred(large, False))
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
