"""Sizes, resizing, fits, padding, crops, masks and tiling of images given as pixels (image_id, w, h, x, y, r, g, b, a).

Every image is taken at its own size ``w`` and ``h``; images of a relation may differ. A source pixel generates the target cells
it takes part in, so nothing is joined: nearest resizing, crops and pads stay narrow, smooth kernels are two grouped sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import settled

RGBA = ("r", "g", "b", "a")
OUT = ["image_id", "w", "h", "x", "y", *RGBA]


def _whole(v: Column) -> Column:
    """Rounded half away from zero, 1 at least."""
    return F.greatest(F.round(v).cast("long"), F.lit(1).cast("long"))


def target_size(mode: str, amount=None, height: int | None = None, w: Column | None = None, h: Column | None = None) -> tuple[Column, Column]:
    """Target width and height of a resize by ``mode``: width, height (the other side keeps the aspect, whole part, 1 at least), exact, or scale."""
    w, h = F.col("w") if w is None else w, F.col("h") if h is None else h
    if mode == "width":
        return F.lit(amount).cast("long"), F.greatest(_div(F.lit(amount) * h, F.greatest(w, F.lit(1))), F.lit(1))
    if mode == "height":
        return F.greatest(_div(F.lit(amount) * w, F.greatest(h, F.lit(1))), F.lit(1)), F.lit(amount).cast("long")
    if mode == "exact":
        return F.lit(amount).cast("long"), F.lit(height).cast("long")
    if mode != "scale" or not (amount > 0 and math.isfinite(amount)):
        raise ValueError("a scale is a positive finite number")
    return _whole(w.cast("double") * amount), _whole(h.cast("double") * amount)


def _div(a: Column, b: Column) -> Column:
    """Whole division of whole numbers, exact at any size."""
    return F.call_function("div", a, b)


def fit_size(mode: str, bw: int, bh: int) -> tuple[Column, Column]:
    """Size an image is scaled to for a box: contain, cover, fill, inside (shrinks only) or outside (grows only)."""
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    pick = F.greatest if mode in ("cover", "outside") else F.least
    r = pick(F.lit(float(bw)) / w, F.lit(float(bh)) / h)
    scaled = _whole(w * r), _whole(h * r)
    if mode == "fill":
        return F.lit(bw).cast("long"), F.lit(bh).cast("long")
    if mode in ("contain", "cover"):
        return scaled
    if mode not in ("inside", "outside"):
        raise ValueError(f"unknown fit {mode}")
    keep = (w <= bw) & (h <= bh) if mode == "inside" else (w >= bw) & (h >= bh)
    return tuple(F.when(keep, F.col(c)).otherwise(s) for c, s in zip("wh", scaled))


def resize_nearest(pixels: DataFrame, target: tuple[Column, Column]) -> DataFrame:
    """Each output pixel takes the source pixel under its centre: each source pixel generates the cells whose centre it holds."""
    d = pixels.withColumns({"tw": target[0], "th": target[1]})
    for t, side, at, out in (("tw", "w", "x", "ox"), ("th", "h", "y", "oy")):
        first = F.expr(f"(2 * {t} * {at} + {side} - 1) div (2 * {side})")
        last = F.expr(f"(2 * {t} * ({at} + 1) + {side} - 1) div (2 * {side}) - 1")
        d = d.where(last >= first).withColumn(out, F.explode(F.sequence(first, last)))
    return d.select("image_id", F.col("tw").alias("w"), F.col("th").alias("h"), F.col("ox").alias("x"), F.col("oy").alias("y"), *RGBA)


def _triangle(t: Column) -> Column:
    return F.greatest(1 - F.abs(t), F.lit(0.0))


def _catmull_rom(t: Column) -> Column:
    x = F.abs(t)
    return F.when(x < 1, (1.5 * x - 2.5) * x * x + 1).when(x < 2, ((2.5 - 0.5 * x) * x - 4) * x + 2).otherwise(0.0)


def gaussian(sigma: float):
    return lambda t: F.exp(-t * t / (2 * sigma * sigma))


def _lanczos3(t: Column) -> Column:
    p = t * math.pi
    return F.when(t == 0, 1.0).when(F.abs(t) < 3, 3 * F.sin(p) * F.sin(p / 3) / (p * p)).otherwise(0.0)


#: Kernel and support of each smooth filter.
KERNELS = {"triangle": (_triangle, 1.0), "catmullrom": (_catmull_rom, 2.0), "gaussian": (gaussian(0.5), 3.0), "lanczos3": (_lanczos3, 3.0)}


def _spread(d: DataFrame, keys: list[str], side: str, at: str, target: str, kernel, support: float, values: list[str]) -> DataFrame:
    """One pass along one axis: each source pixel adds to the targets in its reach, then weighted means per target."""
    ratio = F.col(side).cast("double") / F.col(target)
    scale = F.greatest(ratio, F.lit(1.0))
    # Target o has its centre at (o + 0.5) * ratio; the pixel's own is at + 0.5.
    first = F.greatest(F.floor((F.col(at) + 0.5 - support * scale) / ratio - 0.5), F.lit(0)).cast("long")
    last = F.least(F.ceil((F.col(at) + 0.5 + support * scale) / ratio - 0.5), F.col(target) - 1).cast("long")
    d = d.withColumn("_scale", scale).withColumn("_ratio", ratio).withColumn("_o", F.explode(F.sequence(first, last)))
    t = (F.col(at) + 0.5 - (F.col("_o") + 0.5) * F.col("_ratio")) / F.col("_scale")
    d = d.where(F.abs(t) < support).withColumn("_k", kernel(t))
    rest = [k for k in keys if k != at]
    sums = d.groupBy(*rest, "_o").agg(*[(F.sum(F.col("_k") * F.col(v)) / F.sum("_k")).alias(v) for v in values])
    return sums.withColumnRenamed("_o", at)


def _byte(v: Column) -> Column:
    # Sums come in any order: ties are taken upwards from a hair below.
    return F.least(F.greatest(F.floor(v + 0.5 + 1e-6), F.lit(0)), F.lit(255)).cast("long")


def resample(pixels: DataFrame, target: tuple[Column, Column], kernel, support: float, premultiply: bool = True) -> DataFrame:
    """Separable resampling with a kernel widened by the ratio when shrinking; colours weigh by alpha unless ``premultiply`` is off.

    Two grouped sums combined before their shuffles; a pixel reaches about 2 * support * max(1, target / size) cells per axis.
    """
    share = F.col("a") / 255.0
    d = pixels.withColumns({"tw": target[0], "th": target[1]}).select(
        "image_id", "w", "h", "tw", "th", "x", "y", *[(F.col(c) * share if premultiply else F.col(c).cast("double")).alias(c) for c in "rgb"], F.col("a").cast("double").alias("a"))
    keys = ["image_id", "w", "h", "tw", "th", "x", "y"]
    d = _spread(d, keys, "w", "x", "tw", kernel, support, list(RGBA))
    d = _spread(d, keys, "h", "y", "th", kernel, support, list(RGBA))
    back = (lambda c: F.when(F.col("a") > 0, F.col(c) * 255 / F.col("a")).otherwise(0.0)) if premultiply else F.col
    return d.select("image_id", F.col("tw").alias("w"), F.col("th").alias("h"), "x", "y", *[_byte(back(c)).alias(c) for c in "rgb"], _byte(F.col("a")).alias("a"))


def resize(pixels: DataFrame, target: tuple[Column, Column], kernel: str = "lanczos3") -> DataFrame:
    if kernel == "nearest":
        return resize_nearest(pixels, target)
    return resample(pixels, target, *KERNELS[kernel])


def over_background(colour: tuple[int, int, int, int]) -> dict[str, Column]:
    """Pixel blended over an opaque or translucent background in whole numbers, fractions cut off."""
    fa, ba = F.col("a"), colour[3]
    under = ba * (255 - fa)
    whole = fa * 255 + under
    blended = {c: F.when(whole == 0, v).otherwise(_div(F.col(c) * fa * 255 + v * under, F.greatest(whole, F.lit(1)))) for c, v in zip("rgb", colour)}
    return {c: v.cast("long") for c, v in (blended | {"a": _div(whole, F.lit(255))}).items()}


def pad(pixels: DataFrame, box: tuple[int, int], background: tuple[int, int, int, int]) -> DataFrame:
    """Images centred on a ``box`` of ``background`` and blended over it; what sticks out to the right and below is cut.

    The image's first pixel generates the cells around it.
    """
    bw, bh = box
    dx, dy = (_div(F.greatest(F.lit(b) - F.col(s), F.lit(0)), F.lit(2)) for s, b in zip("wh", box))
    inside = pixels.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy}).where((F.col("x") < bw) & (F.col("y") < bh)).withColumns(over_background(background))
    cells = pixels.where("x = 0 and y = 0").withColumns({"_x": dx, "_y": dy}).withColumn("y", F.explode(F.expr(f"sequence(0L, {bh - 1}L)")))
    cells = cells.withColumn("x", F.explode(F.expr(f"sequence(0L, {bw - 1}L)")))
    border = cells.where("not (x >= _x and x < _x + w and y >= _y and y < _y + h)").withColumns({c: F.lit(v).cast("long") for c, v in zip(RGBA, background)})
    size = {"w": F.lit(bw).cast("long"), "h": F.lit(bh).cast("long")}
    return inside.withColumns(size).select(OUT).unionByName(border.withColumns(size).select(OUT))


def crop_center(pixels: DataFrame, box: tuple[int, int]) -> DataFrame:
    bw, bh = (F.least(F.lit(b).cast("long"), F.col(s)) for s, b in zip("wh", box))
    dx, dy = _div(F.col("w") - bw, F.lit(2)), _div(F.col("h") - bh, F.lit(2))
    d = pixels.withColumns({"x": F.col("x") - dx, "y": F.col("y") - dy, "w": bw, "h": bh})
    return d.where("x between 0 and w - 1 and y between 0 and h - 1")


def fit(pixels: DataFrame, mode: str, box: tuple[int, int], background: tuple[int, int, int, int] = (0, 0, 0, 0), kernel: str = "lanczos3") -> DataFrame:
    """Images scaled to ``box`` by ``fit_size``: contain is padded, cover is cropped at its centre."""
    scaled = resize(pixels, fit_size(mode, *box), kernel)
    return pad(scaled, box, background) if mode == "contain" else crop_center(scaled, box) if mode == "cover" else scaled


def cropped_away(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """(image_id, w, h, error) of images of which the rectangle holds nothing: "invalid" for each, as ``crop`` gives them no row."""
    first = pixels.where("x = 0 and y = 0")
    outside = F.lit(w <= 0 or h <= 0 or x + w <= 0 or y + h <= 0) | (F.lit(x) >= F.col("w")) | (F.lit(y) >= F.col("h"))
    return first.where(outside).select("image_id", "w", "h", F.lit("invalid").alias("error"))


def crop(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The part of the rectangle inside each image; an image it leaves empty has no rows (``cropped_away`` lists those), an empty rectangle is an error."""
    if w <= 0 or h <= 0:
        raise ValueError("an empty rectangle")
    x0, y0 = max(x, 0), max(y, 0)
    right, bottom = F.least(F.col("w"), F.lit(x + w)), F.least(F.col("h"), F.lit(y + h))
    inside = pixels.where((F.col("x") >= x0) & (F.col("x") < right) & (F.col("y") >= y0) & (F.col("y") < bottom))
    return inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0, "w": right - x0, "h": bottom - y0})


def circle_mask(pixels: DataFrame, radius: float | None = None, feather: float = 0) -> DataFrame:
    """Alpha kept up to ``feather`` inside the radius around the centre, falling linearly to 0 at it. The radius is by default half the shorter side."""
    if radius is not None and radius <= 0:
        raise ValueError("a radius is positive")
    outer = F.least("w", "h") / 2.0 if radius is None else F.lit(float(radius))
    inner = F.greatest(outer - feather, F.lit(0.0))
    px, py = F.col("x") + 0.5 - F.col("w") / 2.0, F.col("y") + 0.5 - F.col("h") / 2.0
    apart = F.sqrt(px * px + py * py)
    share = F.when(apart <= inner, 1.0).when(apart >= outer, 0.0).otherwise((outer - apart) / F.greatest(outer - inner, F.lit(1e-6)))
    return pixels.withColumn("a", F.round(F.col("a") * share).cast("long"))


def tile_2x2(pixels: DataFrame) -> DataFrame:
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (0, 1) for i in (0, 1)])
    d = pixels.withColumn("_t", F.explode(places))
    return d.withColumns({"x": F.col("x") + F.col("w") * F.col("_t.i"), "y": F.col("y") + F.col("h") * F.col("_t.j"), "w": 2 * F.col("w"), "h": 2 * F.col("h")}).drop("_t")


def unlike_widths(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """(image_id, w1, w2) of images that ``concat_vertical`` cannot join: of other width, or without a partner (null)."""
    size = lambda d, w: d.where("x = 0 and y = 0").select("image_id", F.col("w").alias(w))
    return size(top, "w1").join(size(bottom, "w2"), "image_id", "full").where("not (w1 <=> w2)")


def concat_vertical(top: DataFrame, bottom: DataFrame, strict: bool = False) -> DataFrame:
    """Images of ``bottom`` below those of the same id and width of ``top``; sizes are one row per image.

    Others are left out and listed by ``unlike_widths``; with ``strict`` any such image is an error.
    """
    if strict and not (odd := unlike_widths(top, bottom).limit(3)).isEmpty():
        raise ValueError(f"images of unlike width: {[tuple(r) for r in odd.collect()]}")
    size = lambda d, h: d.where("x = 0 and y = 0").select("image_id", "w", F.col("h").alias(h))
    both = size(top, "h1").join(size(bottom, "h2"), ["image_id", "w"])
    a = top.join(both, ["image_id", "w"]).withColumn("h", F.col("h1") + F.col("h2"))
    b = bottom.join(both, ["image_id", "w"]).withColumns({"y": F.col("y") + F.col("h1"), "h": F.col("h1") + F.col("h2")})
    return a.select(OUT).unionByName(b.select(OUT))


def downscale_by_2(pixels: DataFrame) -> DataFrame:
    """Mean of each 2x2 block, the last row and column repeated where a side is odd."""
    times = lambda at, side: F.when((F.col(side) % 2 == 1) & (F.col(at) == F.col(side) - 1), 2).otherwise(1)
    weight = times("x", "w") * times("y", "h")
    half = [F.expr(f"({s} + 1) div 2").alias(s) for s in "wh"] + [F.expr(f"{s} div 2").alias(s) for s in "xy"]
    return pixels.groupBy("image_id", *half).agg(*[(F.sum(F.col(c) * weight) / 4.0).alias(c) for c in "rgb"])


def rect_edges(x: Column, y: Column, width: Column, height: Column) -> dict[str, Column]:
    """left, top, right and bottom of a rectangle: the last two are the first places outside, kept within 32-bit numbers."""
    far = lambda at, by: F.least(F.greatest(at.cast("long") + by.cast("long"), F.lit(-(1 << 31))), F.lit((1 << 31) - 1))
    return {"left": x.cast("long"), "top": y.cast("long"), "right": far(x, width), "bottom": far(y, height)}


def size_figures(pixels: DataFrame) -> DataFrame:
    """Area, aspect and emptiness of each image, from its first pixel."""
    first = pixels.where("x = 0 and y = 0")
    return first.select("image_id", (F.col("w") * F.col("h")).alias("area"), (F.col("w") / F.greatest("h", F.lit(1))).alias("aspect"), ((F.col("w") == 0) | (F.col("h") == 0)).alias("is_empty"))


#: The nine anchors: column and row, 0 to 2.
ANCHORS = {f"{v}_{u}": (i, j) for j, v in enumerate(("top", "center", "bottom")) for i, u in enumerate(("left", "center", "right"))}


def anchor(position: str, margin: int, cw: Column, ch: Column, ow: Column, oh: Column) -> tuple[Column, Column]:
    """Where an overlay of size (ow, oh) starts on a canvas; halves are cut toward zero, places may be negative."""
    def along(k: int, c: Column, o: Column) -> Column:
        return (F.lit(margin).cast("long"), _div(c - o, F.lit(2)), c - o - margin)[k]

    i, j = ANCHORS[position]
    return along(i, cw, ow), along(j, ch, oh)


def blend_over(opacity: float, top: str = "s") -> dict[str, Column]:
    """Channels of the columns ``top`` + r, g, b, a over r, g, b, a, opacity times the source alpha, rounded half up."""
    sa = F.col(f"{top}a") / 255.0 * opacity
    da = F.col("a") / 255.0
    out = sa + da * (1 - sa)
    skip = F.col(f"{top}a").isNull() | (sa <= 0)
    mixed = {c: (F.col(f"{top}{c}") * sa + F.col(c) * da * (1 - sa)) / out for c in "rgb"} | {"a": out * 255}
    return {c: F.when(skip, F.col(c)).otherwise(_byte(v)) for c, v in mixed.items()}


def composite_over(canvas: DataFrame, overlay: DataFrame, position: str = "bottom_right", margin: int = 0, opacity: float = 1.0) -> DataFrame:
    """``overlay`` (images of the same ids) blended over ``canvas`` at an anchor; what falls outside is cut."""
    sizes = canvas.where("x = 0 and y = 0").select("image_id", F.col("w").alias("cw"), F.col("h").alias("ch"))
    moved = overlay.join(sizes, "image_id")
    dx, dy = anchor(position, margin, F.col("cw"), F.col("ch"), F.col("w"), F.col("h"))
    moved = moved.select("image_id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), *[F.col(c).alias(f"s{c}") for c in RGBA])
    return canvas.join(moved, ["image_id", "x", "y"], "left").withColumns(blend_over(opacity)).select(OUT)


#: Pixels of resized logos that are broadcast; beyond that canvases are dealt by image.
LOGO_BOUND, LOGO_DEALS = 1 << 21, 32


def watermark(canvas: DataFrame, logo: DataFrame, scale: float, position: str = "bottom_right", margin: int = 0, opacity: float = 1.0, kernel: str = "lanczos3", bound: int = LOGO_BOUND) -> DataFrame:
    """One ``logo`` (pixels of one image, 2**20 at most) on every image, ``scale`` of its width wide, aspect kept.

    The logo is resized once per size that occurs among the canvases. Where all resized logos together have ``bound`` pixels at most they are broadcast, and canvases are not
    shuffled; else both are joined by size, place and one of ``LOGO_DEALS`` numbers of the image, so that images of the commonest size spread over tasks.
    """
    if not 0 < scale:
        raise ValueError("a scale is positive")
    if logo.limit((1 << 20) + 1).count() > 1 << 20:
        raise ValueError("the logo is too large to broadcast")
    sizes = canvas.where("x = 0 and y = 0").select(F.col("w").alias("cw"), F.col("h").alias("ch")).distinct()
    tw = _whole(F.col("cw") * min(scale, 1.0))
    th = _whole(F.col("h").cast("double") * tw / F.col("w"))
    # Each size needs the whole logo: one equi-join on a constant, the logo being checked above.
    sized = sizes.withColumn("_k", F.lit(1)).join(F.broadcast(logo.withColumn("_k", F.lit(1))), "_k").withColumn("image_id", F.struct("cw", "ch", tw.alias("tw"), th.alias("th")))
    small = resize(sized.select(OUT), (F.col("image_id.tw"), F.col("image_id.th")), kernel)
    dx, dy = anchor(position, margin, F.col("image_id.cw"), F.col("image_id.ch"), F.col("w"), F.col("h"))
    small = settled(small.select(F.col("image_id.cw").alias("w"), F.col("image_id.ch").alias("h"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), *[F.col(c).alias(f"s{c}") for c in RGBA]))
    if small.limit(bound + 1).count() <= bound:
        both = canvas.join(F.broadcast(small), ["w", "h", "x", "y"], "left")
    else:
        dealt = small.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(LOGO_DEALS - 1))))
        both = canvas.withColumn("_deal", F.pmod(F.hash("image_id"), F.lit(LOGO_DEALS))).join(dealt, ["w", "h", "x", "y", "_deal"], "left")
    return both.withColumns(blend_over(opacity)).select(OUT)
