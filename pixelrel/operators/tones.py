"""Tone curves, colour spaces and palette assignment: row-local column expressions inside code generation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import RGBA, gaussian, resample
from .lineage import Rounds

# Published OKLab matrices (linear sRGB to cone response, cone response to Lab), luma weights.
TO_LMS = [[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]]
TO_LAB = [[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]]
LUMA = [2126, 7152, 722]


def _byte(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("long")


def _dot(weights: list[float], columns: list[Column]) -> Column:
    return weights[0] * columns[0] + weights[1] * columns[1] + weights[2] * columns[2]


def grayscale(pixels: DataFrame) -> DataFrame:
    luma = F.expr("(" + " + ".join(f"{k} * {c}" for k, c in zip(LUMA, "rgb")) + f") div {sum(LUMA)}")
    return pixels.select("image_id", "w", "h", "x", "y", luma.alias("luma"), "a")


def _away(amount: float) -> int:
    """Nearest whole number, halves away from zero."""
    return int(math.copysign(math.floor(abs(amount) + 0.5), amount))


#: Amount of each filter where none is given.
DEFAULT_AMOUNT = {"grayscale": 0.0, "invert": 0.0, "blur": 1.5, "sharpen": 1.5, "brightness": 20.0, "contrast": 20.0, "hue": 90.0}


def brightness(pixels: DataFrame, amount: float) -> DataFrame:
    return pixels.withColumns({c: _byte(F.col(c) + _away(amount)) for c in "rgb"})


def contrast(pixels: DataFrame, percent: float) -> DataFrame:
    """Distance from mid-grey scaled by ((100 + percent) / 100) squared, truncated."""
    k = ((100 + percent) / 100) ** 2
    return pixels.withColumns({c: _byte(F.floor(((F.col(c) / 255.0 - 0.5) * k + 0.5) * 255.0)) for c in "rgb"})


def hue_matrix(degrees: float) -> list[list[float]]:
    """The usual luminance-keeping hue rotation."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    lum = [0.213, 0.715, 0.072]
    turn = [[-0.213, -0.715, 0.928], [0.143, 0.140, -0.283], [-0.787, 0.715, 0.072]]
    return [[lum[j] + c * ((i == j) - lum[j]) + s * turn[i][j] for j in range(3)] for i in range(3)]


def hue_rotate(pixels: DataFrame, degrees: float) -> DataFrame:
    rgb = [F.col(c) for c in "rgb"]
    return pixels.withColumns({c: _byte(F.floor(_dot(row, rgb))) for c, row in zip("rgb", hue_matrix(_away(degrees)))})


def gaussian_blur(pixels: DataFrame, sigma: float) -> DataFrame:
    """Separable Gaussian of all four channels over two deviations to each side, cut and weighed anew at the edges."""
    if not (sigma >= 0 and math.isfinite(sigma)):
        raise ValueError("sigma is a finite number, 0 at least")
    return pixels if sigma == 0 else resample(pixels, (F.col("w"), F.col("h")), gaussian(sigma), 2 * sigma, premultiply=False)


def unsharp(pixels: DataFrame, sigma: float, threshold: int = 1) -> DataFrame:
    """Each channel moved away from its blurred value where the two differ by more than ``threshold``."""
    if not sigma > 0:
        raise ValueError("sigma is positive")
    soft = gaussian_blur(pixels, sigma).select("image_id", "x", "y", *[F.col(c).alias(f"{c}2") for c in RGBA])
    d = pixels.join(soft, ["image_id", "x", "y"])
    sharp = {c: F.when(F.abs(F.col(c) - F.col(f"{c}2")) > threshold, _byte(2 * F.col(c) - F.col(f"{c}2"))).otherwise(F.col(c)) for c in RGBA}
    return d.withColumns(sharp).select(pixels.columns)


def _starts(pdf: pd.DataFrame) -> np.ndarray:
    """Where a block of an image begins in sorted rows."""
    image, block = pd.factorize(pdf["image_id"], use_na_sentinel=False)[0], pdf["_block"].to_numpy()
    new = np.ones(len(pdf), bool)
    new[1:] = (image[1:] != image[:-1]) | (block[1:] != block[:-1])
    return new


#: Rows of an image that one task takes the medians of.
MEDIAN_ROWS = 64


def median(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """Median of every channel over the square of ``radius`` (0 to 10) around a pixel, edges repeated. All pixels of an image's rectangle are there.

    An image is cut into blocks of rows, each sent once with the ``radius`` rows beside it: one shuffle of little more than the pixels, and a task holds a block at a time. Its medians are taken from windows of one array, some
    rows at a time, so memory follows the block's width.
    """
    if not 0 <= radius <= 10:
        raise ValueError("a radius is 0 to 10")
    if radius == 0:
        return pixels
    side, names = 2 * radius + 1, pixels.columns

    def block_medians(image: np.ndarray, low: int, high: int) -> np.ndarray:
        """Medians of the rows from ``low`` to ``high`` of ``image``; rows that it lacks beside them are those of its edge, as columns are."""
        near = np.pad(image, ((radius - low, radius - (len(image) - 1 - high)), (radius, radius), (0, 0)), mode="edge")
        step, found = max(1, 4_000_000 // (image.shape[1] * 4 * side * side)), []
        for at in range(0, high - low + 1, step):
            part = np.lib.stride_tricks.sliding_window_view(near[at:min(at + step, high - low + 1) + 2 * radius], (side, side), axis=(0, 1))
            found.append(np.partition(part.reshape(*part.shape[:3], -1), side * side // 2, axis=-1)[..., side * side // 2].reshape(-1, 4))
        return np.concatenate(found)

    def medians(pdf: pd.DataFrame) -> pd.DataFrame:
        """All blocks of ``pdf``, one after the other."""
        cuts = np.r_[np.flatnonzero(_starts(pdf)), len(pdf)]
        values, w, y, block = pdf[list(RGBA)].to_numpy(), *(pdf[c].to_numpy() for c in ("w", "y", "_block"))
        own, out = y // MEDIAN_ROWS == block, values.copy()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = y[lo:hi:w[lo]]
            here = np.flatnonzero(rows // MEDIAN_ROWS == block[lo])
            out[lo:hi][own[lo:hi]] = block_medians(values[lo:hi].reshape(-1, w[lo], 4), here[0], here[-1])
        done = pdf.loc[own, names].copy()
        done[list(RGBA)] = out[own]
        return done

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            starts = np.flatnonzero(_starts(pd.concat([held[0].iloc[:1], pdf])))
            # The last block may go on in the next batch.
            if len(starts) > 1:
                cut = starts[-1] - 1
                yield medians(pd.concat([*held[:-1], pdf.iloc[:cut]], ignore_index=True)) if len(held) > 1 or cut else pdf.iloc[:0][names]
                held = [pdf.iloc[cut:]]
        if held and any(map(len, held)):
            yield medians(pd.concat(held, ignore_index=True))

    last = F.expr(f"(h - 1) div {MEDIAN_ROWS}")
    blocks = F.sequence(F.greatest(F.floor((F.col("y") - radius) / MEDIAN_ROWS), F.lit(0)), F.least(F.floor((F.col("y") + radius) / MEDIAN_ROWS), last))
    key = ["image_id", "_block"]
    return pixels.withColumn("_block", F.explode(blocks)).repartition(*key).sortWithinPartitions(*key, "y", "x").mapInPandas(run, pixels.schema)


def linear(v: Column) -> Column:
    s = v / 255.0
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    cones = [F.cbrt(_dot(row, [linear(r), linear(g), linear(b)])) for row in TO_LMS]
    return tuple(_dot(row, cones) for row in TO_LAB)


def with_oklab(pixels: DataFrame) -> DataFrame:
    lab = oklab(*[F.col(c) for c in "rgb"])
    return pixels.withColumns(dict(zip(("ok_l", "ok_a", "ok_b"), lab)))


# The published inverse matrices (Lab to cone response, cubes to linear sRGB).
FROM_LAB = [[1.0, 0.3963377774, 0.2158037573], [1.0, -0.1055613458, -0.0638541728], [1.0, -0.0894841775, -1.2914855480]]
FROM_LMS = [[4.0767416621, -3.3077115913, 0.2309699292], [-1.2684380046, 2.6097574011, -0.3413193965], [-0.0041960863, -0.7034186147, 1.7076147010]]
# Published XYB absorbance of linear RGB and its bias.
XYB = [[0.30, 0.622, 0.078], [0.23, 0.692, 0.078], [0.24342268924547819, 0.20476744424496821, 0.55180986650955360]]
XYB_BIAS = 0.0037930732552754493


def linear_from_oklab(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """Linear sRGB, which may leave 0 to 1."""
    cones = [_dot(row, [l, a, b]) for row in FROM_LAB]
    return tuple(_dot(row, [c * c * c for c in cones]) for row in FROM_LMS)


def encoded(v: Column) -> Column:
    """8-bit sRGB of a linear value, clamped."""
    s = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    return _byte(F.floor(s * 255 + 0.5))


def from_oklab(pixels: DataFrame) -> DataFrame:
    """r, g, b of ok_l, ok_a, ok_b; alpha is full."""
    rgb = linear_from_oklab(F.col("ok_l"), F.col("ok_a"), F.col("ok_b"))
    return pixels.withColumns(dict(zip("rgb", map(encoded, rgb))) | {"a": F.lit(255).cast("long")})


def xyb_planes(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Positive XYB of linear colours: shifted and scaled so that no value is below zero."""
    l, m, s = (F.cbrt(_dot(row, [r, g, b]) + XYB_BIAS) - XYB_BIAS ** (1 / 3) for row in XYB)  # noqa: E741
    x, y = (l - m) / 2, (l + m) / 2
    return x * 14 + 0.42, y + 0.01, (s - y) + 0.55


def with_xyb(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns(dict(zip(("xyb_x", "xyb_y", "xyb_b"), xyb_planes(*[linear(F.col(c)) for c in "rgb"]))))


#: Alpha counts as a fourth coordinate: twice its share of 255.
ALPHA_SCALE = 2 / 255
Entry = tuple[int, int, int, int]


def _entries(palette: list[Entry]) -> Column:
    if not 1 <= len(palette) <= 256:
        raise ValueError("a palette has 1 to 256 entries")
    return F.array(*[F.struct(F.lit(i).alias("idx"), *[c.alias(n) for c, n in zip(oklab(*map(F.lit, p[:3])), "lab")], F.lit(p[3] * ALPHA_SCALE).alias("t")) for i, p in enumerate(palette)])


def assign_palette(pixels: DataFrame, palette: list[Entry], alpha: bool = True) -> DataFrame:
    """``idx`` of the nearest palette entry (r, g, b, a) in OKLab and alpha, the lowest on ties; ``alpha`` off: all count as opaque."""
    own = F.col("a") * ALPHA_SCALE

    def apart(p: Column) -> Column:
        d = [F.col(f"ok_{n}") - p[n] for n in "lab"] + ([own - p["t"]] if alpha else [])
        return F.struct(sum((x * x for x in d[1:]), d[0] * d[0]).alias("d"), p["idx"].alias("idx"))

    return with_oklab(pixels).withColumn("idx", F.array_min(F.transform(_entries(palette), apart))["idx"])


def lloyd_step(pixels: DataFrame, palette: list[Entry]) -> DataFrame:
    """One k-means step: per image and entry the mean OKLab colour and alpha of its pixels, their number and squared error."""
    d = assign_palette(pixels, palette).withColumn("_t", F.col("a") * ALPHA_SCALE)
    parts = ["ok_l", "ok_a", "ok_b", "_t"]
    sse = sum((F.sum(F.col(p) * F.col(p)) - F.sum(p) * F.sum(p) / F.count("*") for p in parts), F.lit(0.0))
    return d.groupBy("image_id", "idx").agg(*[F.avg(p).alias(p) for p in parts[:3]], F.avg("a").alias("alpha"), F.count("*").alias("n"), F.greatest(sse, F.lit(0.0)).alias("sse"))


def importance(pixels: DataFrame, strength: float) -> DataFrame:
    """``weight`` of each pixel: 1 / (1 + strength * mean luma step to the neighbours one and two to the right and below)."""
    along, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    luma = pixels.withColumn("_l", F.expr("(r + g + b) div 3"))
    steps = F.array_compact(F.array(*[F.abs(F.col("_l") - F.lead("_l", k).over(w)) for w in (along, down) for k in (1, 2)]))
    d = luma.withColumn("_s", steps)
    mean = F.when(F.size("_s") > 0, F.aggregate("_s", F.lit(0).cast("long"), lambda x, y: x + y) / F.size("_s")).otherwise(0.0)
    return d.withColumn("weight", 1 / (1 + strength * mean)).drop("_l", "_s")


def compact(assigned: DataFrame, palette: list[Entry]) -> DataFrame:
    """Per image the new index of each used entry, unused ones dropped and the order kept: (image_id, idx, new_idx, r, g, b, a)."""
    used = assigned.select("image_id", "idx").distinct()
    entry = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(p, RGBA)]) for p in palette])
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("idx")) - 1
    return used.withColumns({"new_idx": rank, "_e": F.element_at(entry, F.col("idx") + 1)}).select("image_id", "idx", "new_idx", "_e.*")


def luma_sorted(entries: DataFrame) -> DataFrame:
    """``entries`` (image_id, new_idx, r, g, b, a) with their place by (r + g + b) div 3, the old order on ties."""
    order = Window.partitionBy("image_id").orderBy(F.expr("(r + g + b) div 3"), "new_idx")
    return entries.withColumn("place", F.row_number().over(order) - 1)


def transparency(entries: DataFrame, order: str = "new_idx") -> DataFrame:
    """Per image the alphas to store: none where all entries are opaque, else those up to the last that is not. A palette has 256 entries at most."""
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct(order, "a"))), lambda e: e["a"])
    d = entries.groupBy("image_id").agg(sorted_.alias("alphas"), F.max(F.when(F.col("a") < 255, F.col(order) + 1)).alias("keep"))
    return d.select("image_id", F.coalesce("keep", F.lit(0)).cast("long").alias("stored"), F.array_join(F.slice("alphas", F.lit(1), F.coalesce("keep", F.lit(0))), ",").alias("alphas"))


def sized_palette(entries: Column, n: int) -> Column:
    """The first ``n`` entries; a shorter palette is filled up with its first."""
    return F.concat(F.slice(entries, 1, n), F.array_repeat(F.element_at(entries, 1), F.greatest(F.lit(n) - F.size(entries), F.lit(0))))


def ordered_threshold() -> Column:
    """0 to 63 of the 8x8 ordered matrix at x, y: the bits of x xor y and of y in turn, lowest first into the highest places."""
    x, y = (F.col(c).cast("int") for c in "xy")
    mixed = x.bitwiseXOR(y)
    return sum((F.shiftright(v, k).bitwiseAND(F.lit(1)) * place for k in range(3) for v, place in ((mixed, 32 >> 2 * k), (y, 16 >> 2 * k))), F.lit(0))


def ordered_dither(pixels: DataFrame, palette: list[Entry], threshold: float) -> DataFrame:
    """``idx`` of the nearest palette entry, or the second where the nearest is further than ``threshold`` and its share of both squared distances exceeds the ordered matrix."""
    own = F.col("a") * ALPHA_SCALE

    def apart(p: Column) -> Column:
        d = [F.col(f"ok_{n}") - p[n] for n in "lab"] + [own - p["t"]]
        return F.struct(sum((x * x for x in d[1:]), d[0] * d[0]).alias("d"), p["idx"].alias("idx"))

    near = with_oklab(pixels).withColumn("_near", F.array_sort(F.transform(_entries(palette), apart)))
    best, second = F.get("_near", F.lit(0)), F.get("_near", F.lit(1))
    swap = (best["d"] > threshold * threshold) & (ordered_threshold() / 64 < best["d"] / (best["d"] + second["d"]))
    return near.withColumn("idx", F.when(swap, second["idx"]).otherwise(best["idx"])).drop("_near")


_COORDS = ["ok_l", "ok_a", "ok_b"]

#: Bits of each whole number that a fraction is cut into.
_PART_BITS = 30


def exact_sum(v: Column) -> Column:
    """Sum of doubles, rounded at its end alone, so that no order of rows or partial sums changes it.

    Values are cut into whole numbers (ones, then three times 30 bits behind the point), which add up without rounding: ones below 2**53 in all, fractions of 2**33 values. Digits
    behind 2**-90 are dropped. Beyond that it is a usual sum; NaN and infinite values stay.
    """
    whole = F.rint(v)
    rest, parts = v - whole, []
    for _ in range(3):
        scaled = rest * float(1 << _PART_BITS)
        part = F.rint(scaled)
        rest = scaled - part
        parts.append(F.sum(F.nanvl(part, F.lit(0.0)).cast("long")))
    # Carries leave 0 to 2**30 - 1 in each part, so both halves below are exact and only their sum is rounded.
    carry, digits = F.lit(0).cast("long"), []
    for part in reversed(parts):
        full = part + carry
        carry = F.shiftright(full, _PART_BITS)
        digits.append(full - F.shiftleft(carry, _PART_BITS))
    low, middle, high = (d * 2.0 ** (-_PART_BITS * k) for d, k in zip(digits, (3, 2, 1)))
    return (F.sum(whole) + carry + high) + (middle + low)


def palettes_of(images: DataFrame, palette: list[Entry]) -> DataFrame:
    """The same first palette for every image_id of ``images``: (image_id, idx, ok_l, ok_a, ok_b, alpha)."""
    entry = F.explode(F.transform(_entries(palette), lambda p: F.struct(p["idx"].cast("long").alias("idx"), *[p[n].alias(f"ok_{n}") for n in "lab"], F.round(p["t"] / ALPHA_SCALE).cast("long").alias("alpha"))))
    return images.select("image_id").distinct().select("image_id", entry.alias("e")).select("image_id", "e.*")


def refine_palettes(pixels: DataFrame, palettes: DataFrame, iterations: int, split_rounds: int = 0, least_move: float = 5e-4, stride: int = 1, weight: str | None = None) -> DataFrame:
    """k-means of each image's own palette (image_id, idx, ok_l, ok_a, ok_b, alpha; 256 entries at most) on every ``stride``-th pixel, with ``moves`` (max, mean) of each round.

    ``weight`` names a column of ``pixels`` (such as that of ``importance``): means and errors are weighed by it, and an entry whose pixels weigh nothing stays. Alpha, a whole number, is rounded from
    sums that no order of pixels changes: means halfway between two alphas do occur. In the first ``split_rounds`` rounds unused entries move beside the entries of largest error. An image whose entries all move less than
    ``least_move`` is done. Images without a palette are left out; those without pixels keep theirs.
    """
    seen = with_oklab(pixels.where((F.col("y") * F.col("w") + F.col("x")) % stride == 0)).select("image_id", *_COORDS, "a", (F.col("a") * ALPHA_SCALE).alias("_t"), (F.lit(1.0) if weight is None else F.col(weight)).alias("_w"))
    rounds = Rounds(pixels.sparkSession)
    now = palettes.withColumns({"live": F.lit(True), "moves": F.array().cast("array<struct<max_move:double,mean_move:double>>")})
    for k in range(iterations):
        # A round reads its predecessor twice, so without a written table the plan would double each time.
        # Without weights, sums of alpha are whole numbers.
        now = _refined(seen, rounds.settle(now) if k else now, k < split_rounds, least_move, F.sum if weight is None else exact_sum)
    return now.drop("live")


def _refined(seen: DataFrame, now: DataFrame, split: bool, least_move: float, added: Callable[[Column], Column]) -> DataFrame:
    packed = now.where("live").groupBy("image_id").agg(F.collect_list(F.struct("idx", *_COORDS, (F.col("alpha") * ALPHA_SCALE).alias("_t"))).alias("_p"))
    parts = [*_COORDS, "_t"]

    def apart(p: Column) -> Column:
        d = [F.col(c) - p[c] for c in parts]
        return F.struct(sum((x * x for x in d[1:]), d[0] * d[0]).alias("d"), p["idx"].alias("idx"))

    near = seen.join(packed, "image_id").withColumn("idx", F.array_min(F.transform("_p", apart))["idx"])
    total = added(F.col("_w"))
    weighed = lambda v: F.sum(F.col("_w") * v)
    sse = sum((weighed(F.col(p) * F.col(p)) - weighed(F.col(p)) * weighed(F.col(p)) / total for p in parts), F.lit(0.0))
    step = near.groupBy("image_id", "idx").agg(
        *[(weighed(F.col(c)) / total).alias(f"_{c}") for c in _COORDS], F.round(added(F.col("_w") * F.col("a")) / total).cast("long").alias("_alpha"), total.alias("_n"), sse.alias("_sse")).where("_n >= 1e-9")
    d = now.join(step, ["image_id", "idx"], "left")
    far = [F.col(f"_{c}") - F.col(c) for c in _COORDS] + [(F.col("_alpha") - F.col("alpha")) * ALPHA_SCALE]
    d = d.withColumn("_move", sum((x * x for x in far[1:]), far[0] * far[0]))
    d = d.withColumns({c: F.coalesce(f"_{c}", c) for c in (*_COORDS, "alpha")})
    image = Window.partitionBy("image_id")
    d = d.withColumns({"_max": F.max("_move").over(image), "_mean": F.avg("_move").over(image), "_split": F.lit(False)})
    if split:
        kind = F.when(~F.col("live"), 2).when(F.col("_n").isNull(), 0).when(F.col("_sse") > 0, 1).otherwise(2)
        d = d.withColumn("_kind", kind).withColumn("_rank", F.row_number().over(Window.partitionBy("image_id", "_kind").orderBy(F.desc("_sse"), "idx")))
        half = F.greatest(F.sqrt(F.col("_sse") / F.col("_n")), F.lit(0.001)) / 2
        gone, donors = (F.count_if(F.col("_kind") == k).over(image) for k in (0, 1))
        d = d.withColumns({"_half": half, "_gone": gone, "_split": F.least(gone, donors) > 0})
        # The entry of an empty slot's rank among the image's donors; a palette has 256 entries at most.
        given = F.collect_list(F.when(F.col("_kind") == 1, F.struct(F.col("_rank").alias("rank"), (F.col("ok_l") - F.col("_half")).alias("ok_l"), "ok_a", "ok_b", "alpha"))).over(image)
        d = d.withColumn("_given", F.when(F.col("_kind") == 0, F.get(F.sort_array(given), F.col("_rank") - 1)))
        giving = (F.col("_kind") == 1) & (F.col("_rank") <= F.col("_gone"))
        d = d.withColumn("ok_l", F.when(giving, F.col("ok_l") + F.col("_half")).otherwise(F.col("ok_l"))).withColumns({c: F.coalesce(F.col("_given")[c], F.col(c)) for c in (*_COORDS, "alpha")})
    went = F.array_append("moves", F.struct(F.sqrt("_max").alias("max_move"), F.sqrt("_mean").alias("mean_move")))
    still = F.col("live") & ((F.col("_max") >= least_move * least_move) | F.col("_split"))
    return d.select("image_id", "idx", *_COORDS, "alpha", F.coalesce(still, F.lit(False)).alias("live"), F.when(F.col("live") & F.col("_max").isNotNull(), went).otherwise(F.col("moves")).alias("moves"))


def refinement_trace(refined: DataFrame) -> DataFrame:
    """Per image and round (from 1) the largest and mean move of its entries."""
    return refined.groupBy("image_id").agg(F.first("moves").alias("moves")).select("image_id", F.posexplode("moves").alias("round", "m")).select("image_id", (F.col("round") + 1).alias("round"), "m.*")
