"""Filters and denoising chosen by kind, with the amount each has where none is given."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pixels as plain
from . import tones


def apply_filter(pixels: DataFrame, kind: str, amount: float | None = None) -> DataFrame:
    """``pixels`` after the filter ``kind`` (grayscale, invert, blur, sharpen, brightness, contrast or hue) at ``amount``, that of ``DEFAULT_AMOUNT`` if None. Gray and inverted pictures take no amount."""
    if kind not in tones.DEFAULT_AMOUNT:
        raise ValueError(f"no filter {kind}")
    by = tones.DEFAULT_AMOUNT[kind] if amount is None else amount
    if not math.isfinite(by):
        raise ValueError("an amount is a finite number")
    if kind == "grayscale":
        key = [c for c in pixels.columns if c not in ("r", "g", "b", "a")]
        return tones.grayscale(pixels).select(*key, *[F.col("luma").alias(c) for c in "rgb"], "a")
    if kind == "invert":
        return plain.invert(pixels)
    steps = {"blur": tones.gaussian_blur, "sharpen": tones.unsharp, "brightness": tones.brightness, "contrast": tones.contrast, "hue": tones.hue_rotate}
    return steps[kind](pixels, by)


def denoise(pixels: DataFrame, kind: str, strength: float) -> DataFrame:
    """``pixels`` smoothed by ``kind``: "gaussian" of deviation ``strength`` (0 at least), or "median" over the radius that ``strength`` rounds to, halves away from zero (0 to 10)."""
    if kind == "gaussian":
        return tones.gaussian_blur(pixels, strength)
    if kind == "median":
        if not math.isfinite(strength):
            raise ValueError("a radius is 0 to 10")
        return tones.median(pixels, int(math.copysign(math.floor(abs(strength) + 0.5), strength)))
    raise ValueError(f"no denoising {kind}")
