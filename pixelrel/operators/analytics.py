"""Dataset analytics over result tables: baselines, frontiers and bands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


def compare_to_baseline(results: DataFrame, baseline: DataFrame, limit: float = 1.15) -> DataFrame:
    """Ratio of ``bytes`` to the baseline's of the same name; rows without a baseline never fail."""
    both = results.join(baseline, "name", "left").withColumn("ratio", F.col("bytes") / F.col("baseline_bytes"))
    return both.withColumn("ok", F.coalesce(F.col("ratio") <= limit, F.lit(True)))


def baseline_totals(compared: DataFrame, old: str = "baseline_bytes", new: str = "bytes") -> DataFrame:
    """One row: rows, totals of rows with a baseline, their ratio (null without any), failures, and whether the gate holds."""
    has = F.col(old).isNotNull()
    t = compared.agg(F.count("*").alias("rows"), F.sum(F.when(has, F.col(new))).alias("total_bytes"), F.sum(old).alias("total_baseline"), F.count_if(~F.col("ok")).alias("failures"))
    return t.withColumn("ratio", F.when(F.col("total_baseline") > 0, F.col("total_bytes") / F.col("total_baseline"))).withColumn("passed", F.col("failures") == 0)


def pareto_frontier(rows: DataFrame, group: str, size: str, score: str) -> DataFrame:
    """Rows of each group that no other row of it beats: at most the size and at least the score, one strictly. Equal rows all stand.

    Only the best score of each size can stand, so sizes collapse to one row each first; maxima run over ranges of the sizes (``running``), so no group is one task's. The rows that reach them are joined back.
    """
    best = rows.groupBy(group, size).agg(F.max(score).alias(score))
    standing = running(best, group, [size], maxima={"_top": score}).where(F.col("_top").isNull() | (F.col(score) > F.col("_top"))).drop("_top")
    return rows.join(standing, [group, size, score], "left_semi")


def _counted(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, upto, total): distinct values with their rows, running over ranges of the values, and the rows of their group; null values are none."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col(group).alias("_g")).agg(F.sum("n").alias("total"))
    return running(counts, group, [value], sums={"upto": "n"}).join(totals, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def percentiles(rows: DataFrame, group: str, value: str, shares: Mapping[str, float]) -> DataFrame:
    """Exact percentiles per group, interpolated between the two values beside the place (n - 1) * share: counts per value, summed over ranges, and the rows that hold those places."""
    d = _counted(rows, group, value)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col(value)))

    parts, found = [], []
    for name, share in shares.items():
        place = (F.col("total") - 1) * F.lit(share)
        parts += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high"), F.max(place - F.floor(place)).alias(f"{name}_part")]
        found.append((F.col(f"{name}_low") * (1 - F.col(f"{name}_part")) + F.col(f"{name}_high") * F.col(f"{name}_part")).alias(name))
    return d.groupBy(group).agg(*parts).select(group, *found)


def upper_median(rows: DataFrame, group: str, value: str, weight: str | None = None) -> DataFrame:
    """The element at index n div 2 of each group's sorted values, from counts of distinct values; with ``weight`` also its total per median (work per time)."""
    middle = F.expr("total div 2")
    found = _counted(rows, group, value).where((F.col("upto") > middle) & (F.col("upto") - F.col("n") <= middle)).select(group, F.col(value).alias("median"))
    if weight is None:
        return found
    totals = rows.groupBy(group).agg(F.max(weight).alias("_w"))
    return found.join(totals, group).select(group, "median", (F.col("_w") / F.greatest("median", F.lit(1))).alias("rate"))


def group_averages(rows: DataFrame, group: str, values: list[str], order: list[str] | None = None) -> DataFrame:
    """Integer-divided means per group and the number of rows; with ``order`` only those groups, with their place in it. Groups without rows are left out."""
    means = [F.floor(F.sum(v) / F.count(v)).cast("long").alias(f"avg_{v}") for v in values]
    out = rows.groupBy(group).agg(F.count("*").alias("n"), *means)
    if order is None:
        return out
    place = F.array_position(F.array(*map(F.lit, order)), F.col(group))
    return out.withColumn("place", place).where("place > 0")


def recompression_report(rows: DataFrame, group: str, old: str, new: str) -> DataFrame:
    """Per group the total of both sizes over rows without error and their ratio (the old total counts 1 at least), and the number of error rows (null new size)."""
    good = F.col(new).isNotNull()
    totals = rows.groupBy(group).agg(F.sum(F.when(good, F.col(old))).alias("old_bytes"), F.sum(new).alias("new_bytes"), F.count_if(~good).alias("errors"))
    return totals.withColumn("ratio", F.col("new_bytes") / F.greatest("old_bytes", F.lit(1)))


def recompression_rows(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Each row's ratio; null where there is an error."""
    return rows.withColumn("ratio", F.col(new) / F.greatest(F.col(old), F.lit(1)))


def strategy_ranking(rows: DataFrame, group: str, strategy: str, best: str, fast: str) -> DataFrame:
    """Winner of each group by its best size, winner by its fast size (the first by name on ties), and what the latter costs in best size."""
    pick = lambda by: F.min(F.struct(F.col(by).alias("by"), F.col(strategy).alias("who"), F.col(best).alias("size")))
    d = rows.groupBy(group).agg(pick(best).alias("b"), pick(fast).alias("f"))
    return d.select(group, F.col("b.who").alias("best_winner"), F.col("f.who").alias("fast_winner"), (F.col("f.size") - F.col("b.size")).alias("cost"))


# Dither strengths and quality pairs (least, target) of the full sweep, and those of the compact one.
DITHERS = [0.0, 0.25, 0.5, 0.75, 1.0]
PAIRS = [(0, 10), (0, 30), (0, 50), (0, 80), (0, 90), (0, 95), (0, 100), (50, 90), (50, 95), (70, 95), (80, 95), (80, 100)]
COMPACT = [(d, 0, t) for d in (0.5, 1.0) for t in (80, 95, 100)]


def sweep(images: DataFrame, key: str, lead: Column) -> DataFrame:
    """(key, dither, q_min, q_target): the full grid for rows where ``lead`` holds, the compact one for the others. Each row generates its configurations."""
    def grid(rows) -> Column:
        return F.array(*[F.struct(F.lit(d).alias("dither"), F.lit(a).alias("q_min"), F.lit(b).alias("q_target")) for d, a, b in rows])

    full = grid([(d, a, b) for d in DITHERS for a, b in PAIRS])
    return images.select(key, F.explode(F.when(lead, full).otherwise(grid(COMPACT))).alias("c")).select(key, "c.*")


def distribution(rows: DataFrame, old: str, new: str, score: str) -> DataFrame:
    """Totals of both sizes and their ratio, and least, 10th, 50th and 90th percentile and mean of the score."""
    whole = rows.withColumn("_all", F.lit(0))
    d = whole.groupBy("_all").agg(F.sum(old).alias("old"), F.sum(new).alias("new"), F.min(score).alias("least"), F.avg(score).alias("mean"))
    d = d.join(percentiles(whole, "_all", score, {f"p{p}": p / 100 for p in (10, 50, 90)}), "_all", "left")
    return d.select("old", "new", "least", "p10", "p50", "p90", "mean", (F.col("new") / F.col("old")).alias("ratio"))


def percentiles_by_band(rows: DataFrame, value: str, size: str, bounds: list[int]) -> DataFrame:
    """50th, 90th and 99th percentile and maximum of ``value`` per band of ``size`` (band i holds sizes under ``bounds[i]``)."""
    banded = rows.withColumn("band", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(size))))
    figures = banded.groupBy("band").agg(F.count("*").alias("n"), F.max(value).alias("largest"))
    found = percentiles(banded, "band", value, {f"p{p}": p / 100 for p in (50, 90, 99)})
    return figures.join(found, "band", "left").select("band", "n", "p50", "p90", "p99", "largest")


def size_matrix(rows: DataFrame, key: str, path: str, stage: str, size: str) -> DataFrame:
    """Sizes of two encoding paths side by side and what their gap is made of, from rows (key, path "A" or "B", stage, size).

    Stages are "total", "idat" and "swapped" (the path's filtered rows packed by the other's compressor). filter_gap is what path B keeps above its rows packed
    by A's compressor, deflate_gap what A's rows gain under B's, total_gap B's total less A's. The columns are fixed, so the pivot is one grouping; of
    repeated cells the largest counts, a missing one leaves its figures null.
    """
    pick = lambda p, s: F.max(F.when((F.col(path) == p) & (F.col(stage) == s), F.col(size)))
    wide = rows.groupBy(key).agg(*[pick(p, s).alias(f"{p.lower()}_{s}") for s in ("total", "idat", "swapped") for p in "AB"])
    return wide.withColumns({
        "filter_gap": F.col("b_total") - F.col("b_swapped"), "deflate_gap": F.col("a_swapped") - F.col("a_total"), "total_gap": F.col("b_total") - F.col("a_total")})
