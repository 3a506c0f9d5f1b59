"""The quality that just meets a target, found by bisection of all rows at once against a relation of trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST, HIGHEST = 10, 100


def search_route(format_: Column) -> Column:
    """What a perceptual target means for a format: "search" where it has a quality, "lossless" where it has none, "invalid" where it cannot be searched."""
    return F.when(format_.isin("png", "jpeg", "avif"), "search").when(format_.isin("webp", "gif", "bmp", "tiff"), "lossless").otherwise("invalid")


def _levels(low: int, high: int) -> list[list[int]]:
    """Qualities that each round of a bisection can reach: the middles of the ranges left open."""
    ranges, levels = [(low, high)], []
    while ranges:
        middles = [(a, (a + b) // 2, b) for a, b in ranges]
        levels.append([m for _, m, _ in middles])
        ranges = [r for a, m, b in middles for r in ((a, m - 1), (m + 1, b)) if r[0] <= r[1]]
    return levels


def quality_search(rows: DataFrame, trials: DataFrame, lower_is_better: bool, low: int = LOWEST, high: int = HIGHEST) -> DataFrame:
    """(id, q, score, size, met, tried): of ``rows`` (id, target) the smallest quality tried that meets the target, else the one tried last.

    ``trials`` (id, q, score, size) has one row per id and quality. A round tries the middle of each row's open range: below it is next where the score meets the target,
    above it otherwise. Ranges are columns, so a round is one equi-join by (id, q), and it reads only the qualities that some row can reach in it: together the rounds
    read each trial once. A missing trial, or a score that is null or no number, does not meet; a missing one is no candidate either. A row without candidates keeps null figures. A null target is met by none.
    """
    trial = "struct<q:int,score:double,size:bigint>"
    now = rows.select("id", F.col("target").cast("double").alias("target"), F.lit(low).alias("lo"), F.lit(high).alias("hi"), F.lit(None).cast(trial).alias("best"), F.lit(None).cast(trial).alias("last"), F.lit(0).alias("tried"))
    for level in _levels(low, high):
        reached = trials.where(F.col("q").isin(level)).select("id", F.col("q").cast("int").alias("q"), F.struct(F.col("q").cast("int").alias("q"), F.col("score").cast("double").alias("score"), F.col("size").cast("long").alias("size")).alias("t"))
        middle = F.when(F.col("lo") <= F.col("hi"), F.expr("(lo + hi) div 2").cast("int"))
        d = now.withColumn("q", middle).join(reached, ["id", "q"], "left")
        score = F.when(~F.isnan("t.score"), F.col("t.score"))
        meets = F.coalesce(score <= F.col("target") if lower_is_better else score >= F.col("target"), F.lit(False))
        open_ = F.col("q").isNotNull()
        now = d.select(
            "id", "target", F.when(open_ & ~meets, F.col("q") + 1).otherwise(F.col("lo")).alias("lo"), F.when(open_ & meets, F.col("q") - 1).otherwise(F.col("hi")).alias("hi"),
            F.when(meets, F.col("t")).otherwise(F.col("best")).alias("best"), F.coalesce("t", "last").alias("last"), (F.col("tried") + F.col("t").isNotNull().cast("int")).alias("tried"))
    return now.select("id", F.coalesce("best", "last").alias("t"), F.col("best").isNotNull().alias("met"), "tried").select("id", "t.*", "met", "tried")
