"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import Rounds, settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back: lineage ends there, so a lost executor costs one read."""
    return settled(df, name)


def broadcast_if_small(df: DataFrame, bound: int) -> DataFrame:
    """``df`` hinted for a broadcast join where it has ``bound`` rows at most; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def text_or_empty(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the undirected pairs (u, v)."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        label = new
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    return label


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) by alternating large-star and small-star steps.

    Returns (node, root) for every node of an edge, root being the smallest node reachable. Each step is a
    grouped minimum (combined map-side) and an equi-join, and keeps the edge count linear; its table takes the place of
    its predecessor's. Empty edges give an empty table.
    """
    rounds = Rounds(edges.sparkSession)
    edges = rounds.settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    signature, size = None, edges.count()
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        # A centre may hold most edges: minima (two numbers a node) are broadcast up to 2 million; beyond that those of large centres are.
        edged = both.where("b > a")
        large = edged.join(F.broadcast(low), "a") if size <= 2_000_000 else attach(edged, low, "a", "n", 2 * size)
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.col("b").alias("x"), F.col("m"), F.col("a"))
        new = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = rounds.settle(new)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if signature == tuple(now):
            break
        signature, size = tuple(now), now[0]
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def attach(rows: DataFrame, groups: DataFrame, key: str, size_col: str, total: int, parts: int = 512) -> DataFrame:
    """Left-join one-row-per-key ``groups`` to ``rows`` although a few keys may hold most rows.

    Keys with at least 1/``parts`` of all rows number at most ``parts``, so they are broadcast; the others
    are joined by shuffle, where none is hot.
    """
    heavy = groups.where(F.col(size_col) * parts >= total)
    light = groups.where(F.col(size_col) * parts < total)
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    return hot.unionByName(rest)
