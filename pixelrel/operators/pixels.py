"""Pixel operators: boxes, flips, inversion, statistics, differences and generated pictures.

Images are relations of pixels (image_id, w, h, x, y, r, g, b, a). Filters and tone curves are row-local; per-image
figures are aggregates combined before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import OUT, RGBA, blend_over

RGB = ("r", "g", "b")


def alpha_bbox(pixels: DataFrame, threshold: int = 0) -> DataFrame:
    """Smallest box around the pixels whose alpha exceeds ``threshold``; images without any have no row."""
    box = pixels.where(F.col("a") > threshold).groupBy("image_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return box.select("image_id", "x0", "y0", (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"))


def flip_vertical(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("y", F.col("h") - 1 - F.col("y"))


def flip_horizontal(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("x", F.col("w") - 1 - F.col("x"))


def invert(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({c: 255 - F.col(c) for c in RGB})


def distinct_colours(pixels: DataFrame) -> DataFrame:
    """Distinct colours of the opaque pixels; above a million pixels every fourth is looked at, in row order."""
    seen = pixels.where("a = 255 and (w * h <= 1000000 or (y * w + x) % 4 = 0)")
    return seen.groupBy("image_id", *RGB).agg(F.count("*").alias("n")).groupBy("image_id").agg(F.count("*").alias("colours"), F.max("n").alias("most"))


def sub_filter_cost(pixels: DataFrame, channel: str) -> DataFrame:
    """Per row the sum of absolute signed-byte differences from the pixel to the left (0 before the first)."""
    left = F.coalesce(F.lag(channel).over(Window.partitionBy("image_id", "y").orderBy("x")), F.lit(0))
    byte = F.pmod(F.col(channel) - left, F.lit(256))
    cost = F.when(byte < 128, byte).otherwise(256 - byte)
    return pixels.withColumn("cost", cost).groupBy("image_id", "y").agg(F.sum("cost").alias("cost"))


def largest_difference(left: DataFrame, right: DataFrame, channels: tuple[str, ...] = RGB) -> DataFrame:
    """Per channel the largest absolute difference of images paired by id and position, and the sum of squares over all."""
    other = right.select("image_id", "x", "y", *[F.col(c).alias(f"{c}2") for c in channels])
    parts = [F.col(c) - F.col(f"{c}2") for c in channels]
    return left.join(other, ["image_id", "x", "y"]).groupBy("image_id").agg(
        *[F.max(F.abs(p)).alias(f"max_{c}") for c, p in zip(channels, parts)], F.sum(sum((p * p for p in parts[1:]), parts[0] * parts[0])).alias("sse"))


def _hex(text: Column, at: Column | int, n: int) -> Column:
    digits = F.substring(text, at, n)
    return F.conv(F.concat(digits, digits) if n == 1 else digits, 16, 10).cast("long")


def parse_colour(text: Column) -> Column:
    """Struct (r, g, b, a) of #rgb, #rgba, #rrggbb, #rrggbbaa, black, white, transparent or none in any case; null if it is none of these."""
    t = F.lower(F.trim(text))

    def rgba(*v) -> Column:
        return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("long").alias(c) for x, c in zip(v, RGBA)])

    one, two = [_hex(t, k + 2, 1) for k in range(4)], [_hex(t, 2 * k + 2, 2) for k in range(4)]
    return (
        F.when(t.isin("transparent", "none"), rgba(0, 0, 0, 0)).when(t == "black", rgba(0, 0, 0, 255)).when(t == "white", rgba(255, 255, 255, 255))
        .when(t.rlike("^#[0-9a-f]{3}$"), rgba(*one[:3], 255)).when(t.rlike("^#[0-9a-f]{4}$"), rgba(*one))
        .when(t.rlike("^#[0-9a-f]{6}$"), rgba(*two[:3], 255)).when(t.rlike("^#[0-9a-f]{8}$"), rgba(*two))
    )


def darken(v: Column, share: float) -> Column:
    return F.round(v * (1 - min(max(share, 0.0), 1.0))).cast("long")


def lerp(a: Column, b: Column, t: Column) -> Column:
    return F.round(a + (b - a) * t).cast("long")


def mock(sizes: DataFrame, style: str, background: tuple[int, int, int, int], foreground: tuple[int, int, int, int] = (0, 0, 0, 255), tile: int = 32) -> DataFrame:
    """Pictures generated at the sizes (image_id, w, h): solid, stripes, gradient or checker. Each size generates its own rows and pixels."""
    cells = sizes.select("image_id", "w", "h").where("w > 0 and h > 0").withColumn("y", F.explode(F.expr("sequence(0L, cast(h as bigint) - 1)")))
    cells = cells.withColumn("x", F.explode(F.expr("sequence(0L, cast(w as bigint) - 1)"))).withColumns({c: F.lit(v).cast("long") for c, v in zip(RGBA, background)})
    if style == "stripes":
        spacing = F.least(F.greatest(F.expr("least(w, h) div 60"), F.lit(10)), F.lit(20))
        on = (F.col("x") + F.col("y")) % spacing == 0
        cells = cells.withColumns({f"s{c}": F.when(on, F.lit(v)) for c, v in zip(RGBA, foreground)}).withColumns(blend_over(0.07))
    elif style == "gradient":
        t = F.col("y") / F.greatest(F.col("h") - 1, F.lit(1))
        cells = cells.withColumns({c: lerp(F.col(c), darken(F.col(c), 0.08), t) for c in RGB})
    elif style == "checker":
        side = max(tile, 4)
        odd = F.expr(f"(x div {side} + y div {side}) % 2 = 1")
        cells = cells.withColumns({c: F.when(odd, darken(F.col(c), 0.04)).otherwise(F.col(c)) for c in RGB})
    elif style != "solid":
        raise ValueError(f"unknown style {style}")
    return cells.select(OUT)
