"""Near-duplicate vectors by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, components, forest, stage, table

COSINE = 0.95
TILE = 8192
LEAD = 16
#: Axes are fitted on so many vectors at most, and for lengths up to ``AXES_DIM`` that a sixteenth of them has: a bounded number of cells reaches the driver.
AXES_SAMPLE, AXES_DIM = 20_000, 1024
RANGES = 1000


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in column])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _slack(dim: int) -> float:
    """More than a single-precision product of unit vectors of ``dim`` components is off: a rounding of 2^-24 a term and for each factor, doubled."""
    return (dim + 8) * 2.0 ** -23


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length axes by falling variance, fitted on ``AXES_SAMPLE`` vectors at most; any orthonormal axes keep the comparison exact.

    Lengths that are long, or rare among those vectors, have none: the components as they are serve them.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, g in pdf.groupby("dim"):
                u = _unit(g["embedding"])
                acc[dim] = acc.get(dim, 0) + u.T @ u
        for dim, m in acc.items():
            n = int(dim)
            yield pd.DataFrame({"dim": n, "cell": np.arange(n * n), "v": m.ravel()})

    sample = stage(vectors.limit(AXES_SAMPLE), "sample")
    counts = {r["dim"]: r["count"] for r in sample.where(F.col("dim") <= AXES_DIM).groupBy("dim").count().collect()}
    chosen = [d for d, n in counts.items() if 16 * n >= sum(counts.values())]
    cells = sample.where(F.col("dim").isin(chosen)).mapInPandas(sums, "dim int, cell int, v double").groupBy("dim", "cell").agg(F.sum("v").alias("v")).toPandas()
    axes = {}
    for dim, g in cells.groupby("dim"):
        m = g.sort_values("cell")["v"].to_numpy().reshape(dim, dim)
        axes[int(dim)] = np.linalg.eigh(m)[1][:, ::-1]
    return axes


def _suffix_norms(x: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Norms of the components from each cut on, summed in double precision from the end and rounded up."""
    tails = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return [np.nextafter((np.sqrt(tails[:, c]) * (1 + 1e-12)).astype(np.float32), np.float32(np.inf)) if c < x.shape[1] else np.zeros(len(x), np.float32) for c in cuts]


def _compare(left: pd.DataFrame, right: pd.DataFrame, same: bool, axes: np.ndarray | None, threshold: float, block: int = 1024):
    """(i, j) of pairs at or over ``threshold``.

    Components are added ``LEAD`` at a time in the order of the axes. After each step the residual products are bounded by the product of the
    suffix norms (taken in double precision and rounded up, with a slack for single-precision products); pairs that cannot reach the threshold stop there, the last ones are decided by whole cosines in double precision.
    """
    u, v = _unit(left["embedding"]), _unit(right["embedding"])
    turned = [u, v] if axes is None else [u @ axes, v @ axes]
    cuts, slack = list(range(LEAD, u.shape[1], LEAD)) or [u.shape[1]], _slack(u.shape[1])
    norms, (a, b) = [_suffix_norms(x, cuts) for x in turned], (x.astype(np.float32) for x in turned)
    # The first step is a matrix product for all pairs: one more column takes the bound into it.
    a1, b1 = (np.column_stack([x[:, :cuts[0]], n[0]]) for x, n in zip((a, b), norms))
    for i in range(0, len(a), block):
        for j in range(i if same else 0, len(b), block):
            x, y = np.nonzero(a1[i:i + block] @ b1[j:j + block].T >= threshold - slack)
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), 200_000):
                p, q = x[at:at + 200_000], y[at:at + 200_000]
                product = np.einsum("ij,ij->i", a[p, :cuts[0]], b[q, :cuts[0]])
                for step, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:]), 1):
                    product += np.einsum("ij,ij->i", a[p, lo:hi], b[q, lo:hi])
                    live = product + norms[0][step][p] * norms[1][step][q] >= threshold - slack
                    p, q, product = p[live], q[live], product[live]
                hit = np.einsum("ij,ij->i", u[p], v[q]) >= threshold
                yield p[hit], q[hit]


def _tiled(nodes: DataFrame, axes: dict[int, np.ndarray], threshold: float, tile: int) -> DataFrame:
    """``nodes`` once per pair (i, j) of tiles to compare, with their own tile t.

    Tiles are ranges of the leading coordinate. Unit vectors of cosine ``threshold`` lie sqrt(2 - 2 * threshold) apart at most, and so do their
    coordinates: ranges further apart are never paired. Ranges of more than ``tile`` vectors (ties) are split by hash.
    """
    held, reach = nodes.sparkSession.sparkContext.broadcast({d: x[:, 0] for d, x in axes.items()}), float(np.sqrt(max(2 - 2 * threshold, 0))) + 1e-9

    @F.pandas_udf("double")
    def leading(dim: pd.Series, embedding: pd.Series) -> pd.Series:
        out = np.zeros(len(dim))
        for d in dim.unique():
            at = np.flatnonzero(dim == d)
            u = _unit(embedding.iloc[at])
            out[at] = u @ held.value[int(d)] if int(d) in held.value else u[:, 0]
        return pd.Series(out)

    placed = stage(nodes.select("dim", "node", "n", "embedding", leading("dim", "embedding").alias("c")), "leading")
    counts = placed.groupBy("dim").count()
    most = counts.agg(F.max("count")).first()[0] or 0
    if most <= tile:
        return placed.select("dim", "node", "n", "embedding", *[F.lit(0).alias(x) for x in "tij"])
    ranges = min(RANGES, -(-most // tile))
    cuts = placed.groupBy("dim").agg(F.array_distinct(F.percentile_approx("c", [k / ranges for k in range(1, ranges)], 10_000)).alias("cuts"))
    # Per vector length at most RANGES cuts: a small table.
    dealt = placed.join(F.broadcast(cuts), "dim").withColumn("r", F.size(F.filter("cuts", lambda x: x < F.col("c")))).drop("cuts")
    spans = dealt.groupBy("dim", "r").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    order = Window.partitionBy("dim").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("m", F.expr(f"(m + {tile} - 1) div {tile}").cast("int")).withColumn("last", (F.sum("m").over(order) - 1).cast("int"))
    spans = spans.withColumn("first", F.col("last") - F.col("m") + 1)
    near = spans.alias("x").join(spans.alias("y"), F.expr(f"x.dim = y.dim and y.lo <= x.hi + {reach} and y.hi >= x.lo - {reach}"))
    near = near.groupBy(F.col("x.dim").alias("dim"), F.col("x.r").alias("r")).agg(
        F.first("x.first").alias("first"), F.first("x.m").alias("m"), F.min("y.first").alias("low"), F.max("y.last").alias("high"))
    tiles = dealt.join(F.broadcast(near), ["dim", "r"]).withColumn("t", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("m"))).cast("int"))
    tiles = tiles.select("dim", "node", "n", "embedding", "t", F.explode(F.sequence("low", "high")).alias("o"))
    return tiles.select("dim", "node", "n", "embedding", "t", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"))


def near_vectors(vectors: DataFrame, threshold: float = COSINE, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors are one node with a count, so copies cost one row per partition. Nodes lie in tiles of about ``tile`` by their
    leading coordinate, and every pair of tiles near enough (``_tiled``) is one task, which compares step by step (``_compare``) and emits
    link counts per node and a spanning forest. The comparison is exact; where tiles cannot be told apart its cost is the node count
    squared, over the tile pairs. Null, zero and non-finite vectors link with nothing, vectors of differing lengths not with
    each other, whatever lengths there are;
    null-id rows keep a null component unless linked to an id; an empty table gives an empty result; other columns are ignored.
    """
    arr = F.col("embedding").cast("array<double>")
    biggest = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (biggest > 0)
    rows = stage(vectors.select("vec_id", arr.alias("embedding")).withColumn("good", F.coalesce(good, F.lit(False))), "vectors")
    live = rows.where("good")
    nodes = live.groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "nodes")
    axes = principal_axes(nodes.select("dim", "embedding"))
    held = nodes.sparkSession.sparkContext.broadcast(axes)

    def tile_pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["t"] == key[1]], pdf[pdf["t"] == key[2]]
        same = key[1] == key[2]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "w": []}).astype("int64")
        left = left.reset_index(drop=True)
        right = left if same else right.reset_index(drop=True)
        ids = left["node"].to_numpy() if same else np.concatenate([left["node"], right["node"]])
        n = left["n"].to_numpy() if same else np.concatenate([left["n"], right["n"]])
        shift, label, weight = 0 if same else len(left), np.arange(len(ids)), np.zeros(len(ids))
        for p, q in _compare(left, right, same, held.value.get(int(key[0])), threshold):
            q = q + shift
            weight += np.bincount(p, n[q], len(ids)) + np.bincount(q, n[p], len(ids))
            apart = label[p] != label[q]
            if apart.any():
                at = np.arange(len(ids))
                label = forest(np.concatenate([at, p[apart]]), np.concatenate([label, q[apart]]), len(ids))
        some = np.flatnonzero(weight)
        return pd.DataFrame({"a": ids[some], "b": ids[label[some]], "w": weight[some].astype(np.int64)})

    paired = _tiled(nodes, axes, threshold, tile)
    found = stage(paired.groupBy("dim", "i", "j").applyInPandas(tile_pair, "a long, b long, w long"), "links")
    roots = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
    tagged = nodes.select("node", "embedding", "n", "low").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = tagged.groupBy("root").agg(F.min("low").alias("component_id"))
    final = stage(tagged.join(smallest, "root").select("embedding", "n", "component_id", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links")), "groups")
    total = max(rows.count(), 1)
    linked = attach(live.select("vec_id", "embedding"), final, "embedding", "n", total).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT c.x AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.x = component_id AS kept FROM c LEFT JOIN n ON c.x = n.x
"""
