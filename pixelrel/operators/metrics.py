"""Likeness of two images as relations: products of planes, local moments, structural and edge errors pooled per scale and plane, and their weighted score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled
from .tones import linear, xyb_planes

#: Fixed value: the published stabiliser of the structural term.
C2 = 0.0009
#: Response of the recursive Gaussian filter (deviation 1.5, radius 5) at distances 0 to 4; it ends there.
SMOOTH = [0.26462110548819856, 0.2129285920104222, 0.10933537277746032, 0.036011114658364374, 0.0094143678096537]
#: Scales of a score, and the least side of an image that is scaled down once more.
SCALES, LEAST_SIDE = 6, 8
#: Weights of the score by plane, scale, and then mean and 4-norm of structural error, artefacts and lost detail.
WEIGHTS = [
    0.0, 0.0007376606707406586, 0.0, 0.0, 0.0007793481682867309, 0.0, 0.0, 0.0004371155730107379, 0.0, 1.1041726426657346, 0.00066284834129271, 0.00015231632783718752,
    0.0, 0.0016406437456599754, 0.0, 1.8422455520539298, 11.441172603757666, 0.0, 0.0007989109436015163, 0.000176816438078653, 0.0, 1.8787594979546387, 10.94906990605142, 0.0,
    0.0007289346991508072, 0.9677937080626833, 0.0, 0.00014003424285435884, 0.9981766977854967, 0.00031949755934435053, 0.0004550992113792063, 0.0, 0.0, 0.0013648766163243398, 0.0, 0.0,
    0.0, 0.0, 0.0, 7.466890328078848, 0.0, 17.445833984131262, 0.0006235601634041466, 0.0, 0.0, 6.683678146179332, 0.00037724407979611296, 1.027889937768264,
    225.20515300849274, 0.0, 0.0, 19.213238186143016, 0.0011401524586618361, 0.001237755635509985, 176.39317598450694, 0.0, 0.0, 24.43300999870476, 0.28520802612117757, 0.0004485436923833408,
    0.0, 0.0, 0.0, 34.77906344483772, 44.835625328877896, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
    0.0, 0.0008680556573291698, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0005313191874358747, 0.0, 0.00016533814161379112, 0.0, 0.0,
    0.0, 0.0, 0.0, 0.0004179171803251336, 0.0017290828234722833, 0.0, 0.0020827005846636437, 0.0, 0.0, 8.826982764996862, 23.19243343998926, 0.0,
    95.1080498811086, 0.9863978034400682, 0.9834382792465353, 0.0012286405048278493, 171.2667255897307, 0.9807858872435379, 0.0, 0.0, 0.0, 0.0005130064588990679, 0.0, 0.00010854057858411537,
]
#: Scale of the weighted sum, factors of its first, second and third power, and the power of the result.
SUM_SCALE, CUBIC, POWER = 0.9562382616834844, (2.326765642916932, -0.020884521182843837, 6.248496625763138e-5), 0.6276336467831387


def plane_products(pixels: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A column ``name`` for each (name, left, right): the product of two planes, pixel by pixel."""
    return pixels.withColumns({name: F.col(left) * F.col(right) for name, left, right in pairs})


def moments(cells: DataFrame, weights: Sequence[float] = SMOOTH, key: Sequence[str] = ("image_id", "plane")) -> DataFrame:
    """mu1, mu2, s11, s22, s12 of (*key, x, y, v1, v2): sums of the values and of their products around each pixel, weighted by ``weights`` of the distance along x times along y.

    ``weights`` are those of distances 0, 1, ...; pixels beyond an edge count as zero and nothing is weighed anew. The smoothing is separable: one pass of windows
    along rows, then one along columns, so a task holds a row or a column, never an image. All pixels of an image's rectangle are there.
    """
    along, down = Window.partitionBy(*key, "y").orderBy("x"), Window.partitionBy(*key, "x").orderBy("y")
    d = plane_products(cells, [("s11", "v1", "v1"), ("s22", "v2", "v2"), ("s12", "v1", "v2")]).withColumns({"mu1": F.col("v1"), "mu2": F.col("v2")})
    names = ["mu1", "mu2", "s11", "s22", "s12"]

    def smooth(v: str, window) -> Column:
        near = lambda k: F.coalesce(F.lag(v, k).over(window), F.lit(0.0)) + F.coalesce(F.lead(v, k).over(window), F.lit(0.0))
        return sum((near(k) * w for k, w in enumerate(weights) if k), F.col(v) * weights[0])

    for window in (along, down):
        d = d.withColumns({v: smooth(v, window) for v in names})
    return d


def _pooled(name: str, error: Column) -> list[Column]:
    """Mean and 4-norm of an error over the pixels."""
    return [F.avg(error).alias(f"{name}_mean"), F.pow(F.avg(F.pow(error, F.lit(4))), F.lit(0.25)).alias(f"{name}_norm4")]


def _structural() -> list[Column]:
    gap = F.col("mu1") - F.col("mu2")
    joint = 2 * (F.col("s12") - F.col("mu1") * F.col("mu2")) + C2
    own = (F.col("s11") - F.col("mu1") * F.col("mu1")) + (F.col("s22") - F.col("mu2") * F.col("mu2")) + C2
    return _pooled("ssim", F.greatest(1 - (1 - gap * gap) * joint / own, F.lit(0.0)))


def _edges() -> list[Column]:
    change = (1 + F.abs(F.col("v2") - F.col("mu2"))) / (1 + F.abs(F.col("v1") - F.col("mu1"))) - 1
    return [*_pooled("artefact", F.greatest(change, F.lit(0.0))), *_pooled("lost", F.greatest(-change, F.lit(0.0)))]


def structural_errors(moments: DataFrame) -> DataFrame:
    """Per image and plane the mean and 4-norm of one less the likeness of means and of variances, not below zero. Partial sums combine before the shuffle."""
    return moments.groupBy("image_id", "plane").agg(*_structural())


def edge_errors(moments: DataFrame) -> DataFrame:
    """Per image and plane the mean and 4-norm of edges the second image adds (artefacts) and of those it loses (detail), an edge being the distance from the local mean."""
    return moments.groupBy("image_id", "plane").agg(*_edges())


_LINEAR = [f"{c}{k}" for k in (1, 2) for c in "rgb"]


def linear_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(image_id, w, h, x, y, r1, g1, b1, r2, g2, b2): linear colours of images of the same id and size, side by side; alpha is dropped. Others have no partner and no row."""
    side = lambda d, k: d.select("image_id", "w", "h", "x", "y", *[linear(F.col(c)).alias(f"{c}{k}") for c in "rgb"])
    return side(first, 1).join(side(second, 2), ["image_id", "w", "h", "x", "y"])


def pyramid(pairs: DataFrame, scales: int = SCALES, least: int = LEAST_SIDE) -> DataFrame:
    """``pairs`` at up to ``scales`` scales, with ``scale`` from 0: each is the 2x2 means of the one before, edges repeated; a side below ``least`` is the last that is reached.

    Images with a side below ``least`` have no scale at all. Each scale is written and its successor made from that table (all smaller ones are a third of the first), so plans do not grow.
    """
    levels = [settled(pairs.where((F.col("w") >= least) & (F.col("h") >= least)).select("image_id", "w", "h", "x", "y", *_LINEAR))]
    times = lambda at, side: F.when((F.col(side) % 2 == 1) & (F.col(at) == F.col(side) - 1), 2).otherwise(1)
    half = [F.expr(f"({s} + 1) div 2").alias(s) for s in "wh"] + [F.expr(f"{s} div 2").alias(s) for s in "xy"]
    for _ in range(1, scales):
        large = levels[-1].where((F.col("w") >= least) & (F.col("h") >= least))
        levels.append(settled(large.groupBy("image_id", *half).agg(*[(F.sum(F.col(c) * times("x", "w") * times("y", "h")) / 4.0).alias(c) for c in _LINEAR])))
    every = levels[0].withColumn("scale", F.lit(0))
    for scale, level in enumerate(levels[1:], 1):
        every = every.unionByName(level.withColumn("scale", F.lit(scale)))
    return every


def scale_errors(scaled: DataFrame) -> DataFrame:
    """(image_id, scale, plane, six figures) of ``pyramid``: structural and edge errors of the shifted XYB planes on Gaussian moments."""
    one, two = (xyb_planes(*[F.col(f"{c}{k}") for c in "rgb"]) for k in (1, 2))
    planes = F.explode(F.array(*[F.struct(F.lit(i).alias("plane"), a.alias("v1"), b.alias("v2")) for i, (a, b) in enumerate(zip(one, two))]))
    cells = scaled.select("image_id", "scale", "x", "y", planes.alias("p")).select("image_id", "scale", "x", "y", "p.*")
    key = ["image_id", "scale", "plane"]
    return moments(cells, SMOOTH, key).groupBy(*key).agg(*_structural(), *_edges())


def weighted_score(errors: DataFrame) -> DataFrame:
    """(image_id, scales, score) of ``scale_errors``: 100 is equal, less is worse.

    A figure's weight is that at its place in the order of plane, scale, mean before 4-norm, and structural error, artefact, lost detail; with fewer scales the places
    close up, so they follow from each image's own number of scales. The 108 weights are a relation joined by place.
    """
    spark = errors.sparkSession
    weights = spark.createDataFrame(list(enumerate(WEIGHTS)), "place int, weight double")
    counts = errors.groupBy("image_id").agg((F.max("scale") + 1).alias("scales"))
    figures = ["ssim_mean", "artefact_mean", "lost_mean", "ssim_norm4", "artefact_norm4", "lost_norm4"]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).alias("v")) for i, f in enumerate(figures)]))
    placed = errors.select("image_id", "scale", "plane", each.alias("e")).join(counts, "image_id").withColumn("place", ((F.col("plane") * F.col("scales") + F.col("scale")) * 6 + F.col("e.i")).cast("int"))
    total = placed.join(F.broadcast(weights), "place").groupBy("image_id", "scales").agg((F.sum(F.abs("e.v") * F.col("weight")) * SUM_SCALE).alias("s"))
    s = F.col("s")
    bent = CUBIC[2] * s * s * s + (CUBIC[0] * s + CUBIC[1] * s * s)
    return total.withColumn("bent", bent).select("image_id", "scales", F.when(F.col("bent") > 0, 100 - 10 * F.pow("bent", F.lit(POWER))).otherwise(100.0).alias("score"))


def likeness(first: DataFrame, second: DataFrame) -> DataFrame:
    """(image_id, scales, score) of images of the same id and size; both sides have 8 pixels at least, else there is no row."""
    return weighted_score(scale_errors(pyramid(linear_pairs(first, second))))
