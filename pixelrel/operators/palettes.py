"""Palettes trained per image by median cut over counted colours: all images, and all boxes of a round, are cut at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import Rounds
from .tones import oklab

CHANNELS = ["r", "g", "b", "a"]


def counted_colours(pixels: DataFrame, alpha: bool = True) -> DataFrame:
    """(image_id, r, g, b, a, n): every colour of an image once, with its pixels; ``alpha`` off: all count as opaque. Combined before the shuffle."""
    colours = pixels if alpha else pixels.withColumn("a", F.lit(255).cast("long"))
    return colours.groupBy("image_id", *CHANNELS).agg(F.count("*").alias("n"))


def _cuts(boxes: DataFrame, k: int) -> DataFrame:
    """(image_id, box, channel, cut) of the boxes to split.

    A box is cut along its widest channel (the first of r, g, b, a on ties) at the weighted median: the smallest value that half its pixels do not
    exceed, or the value before it where that is the largest, so that both sides hold pixels. Where fewer than all may be split, those of the most pixels times range are.
    Counts per value come first: a window sees 256 rows of a channel, and as many boxes as a palette has entries.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), F.col(c).alias("v")) for i, c in enumerate(CHANNELS)]))
    counts = boxes.select("image_id", "box", "n", each.alias("e")).groupBy("image_id", "box", "e.channel", "e.v").agg(F.sum("n").alias("n"))
    side = Window.partitionBy("image_id", "box", "channel")
    d = counts.withColumns({
        "upto": F.sum("n").over(side.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(side), "top": F.max("v").over(side)})
    sides = d.groupBy("image_id", "box", "channel").agg(
        (F.max("v") - F.min("v")).alias("range"), F.max("total").alias("total"), F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("v"))).alias("middle"),
        F.max("top").alias("top"), F.max(F.when(F.col("v") < F.col("top"), F.col("v"))).alias("below"))
    cut = F.when(F.col("middle") == F.col("top"), F.col("below")).otherwise(F.col("middle"))
    widest = sides.groupBy("image_id", "box").agg(F.max(F.struct("range", (-F.col("channel")).alias("first"), cut.alias("cut"), "total")).alias("s"))
    image = Window.partitionBy("image_id")
    ranked = widest.withColumns({
        "room": F.lit(k) - F.count("*").over(image),
        "place": F.row_number().over(image.orderBy((F.col("s.range") > 0).desc(), (F.col("s.total") * F.col("s.range")).desc(), "box"))})
    return ranked.where("s.range > 0 and place <= room").select("image_id", "box", (-F.col("s.first")).alias("channel"), "s.cut")


def median_cut(pixels: DataFrame, k: int, alpha: bool = True) -> DataFrame:
    """(image_id, idx, r, g, b, a, n): at most ``k`` entries per image (2 to 256), the rounded mean colours of its boxes with their pixels, in the order of the cuts.

    The rounds are as many as doublings from one box to ``k``; a round that may not split all boxes splits the heaviest. An image of fewer colours than ``k`` ends with one box a
    colour at most; repeated pixels count each. Images without pixels have no palette. Each round is written, so plans do not grow.
    """
    if not 2 <= k <= 256:
        raise ValueError("a palette of 2 to 256 entries is trained")
    rounds = Rounds(pixels.sparkSession)
    boxes = rounds.settle(counted_colours(pixels, alpha).withColumn("box", F.lit(0).cast("long")))
    for _ in range((k - 1).bit_length()):
        value = F.coalesce(*[F.when(F.col("channel") == i, F.col(c)) for i, c in enumerate(CHANNELS)])
        upper = F.coalesce((value > F.col("cut")).cast("long"), F.lit(0))
        split = boxes.join(_cuts(boxes, k), ["image_id", "box"], "left")
        boxes = rounds.settle(split.withColumn("box", F.col("box") * 2 + upper).select(boxes.columns))
    means = [F.expr(f"(2 * sum(n * {c}) + sum(n)) div (2 * sum(n))").alias(c) for c in CHANNELS]
    entries = boxes.groupBy("image_id", "box").agg(*means, F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("box")) - 1
    return entries.select("image_id", place.cast("long").alias("idx"), *CHANNELS, "n")


def trained_palettes(pixels: DataFrame, k: int, alpha: bool = True) -> DataFrame:
    """(image_id, idx, ok_l, ok_a, ok_b, alpha) for ``refine_palettes``: the entries of ``median_cut``, filled up to ``k`` with copies of the first."""
    entries = median_cut(pixels, k, alpha)
    coords: list[Column] = [v.alias(n) for v, n in zip(oklab(*map(F.col, "rgb")), ("ok_l", "ok_a", "ok_b"))]
    spare = F.when(F.col("idx") == 0, F.sequence(F.col("own"), F.lit(k).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    # The sequence ends with k, which is no place; the entry's own place comes first.
    places = F.concat(F.array("idx"), F.filter(spare, lambda i: i < k))
    d = entries.withColumn("own", F.count("*").over(Window.partitionBy("image_id")))
    return d.select("image_id", F.explode(places).alias("idx"), *coords, F.col("a").alias("alpha"))
