"""Running totals within groups of any size: rows are cut into ranges of the order, each range is summed apart, and totals of ranges carry over."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled

RANGE, SAME = "_range", "_same"


def running(rows: DataFrame, group: str, order: Sequence[str], sums: Mapping[str, str] | None = None, maxima: Mapping[str, str] | None = None) -> DataFrame:
    """``rows`` with running sums (name to column, up to and with the row) and running maxima (of the rows before it; null for the first) along ``order`` in each group.

    Ranges are those of a range partitioning by (group, order), written so that they stay. A group that lies in one range needs no other; at most one group reaches into a
    range from before, so the carried totals number at most as many as ranges and are broadcast. A window holds one group's rows of one range. Null groups are a group.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    ranged = settled(rows.withColumn(SAME, F.struct(group)).repartitionByRange(SAME, *order).withColumn(RANGE, F.spark_partition_id()))
    parts = ranged.groupBy(SAME, RANGE).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_m_{n}") for n, c in maxima.items()])
    before = Window.partitionBy(SAME).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        SAME, RANGE, *[F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in sums], *[F.max(f"_m_{n}").over(before).alias(f"_m_{n}") for n in maxima], F.count("*").over(before).alias("_n")).where("_n > 0").drop("_n")
    here = Window.partitionBy(SAME, RANGE).orderBy(*order)
    upto, ahead = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    d = ranged.withColumns({f"_h_{n}": F.sum(c).over(upto) for n, c in sums.items()} | {f"_b_{n}": F.max(c).over(ahead) for n, c in maxima.items()})
    d = d.join(F.broadcast(carried), [SAME, RANGE], "left")
    found: dict[str, Column] = {n: F.col(f"_h_{n}") + F.coalesce(F.col(f"_s_{n}"), F.lit(0)) for n in sums} | {n: F.greatest(f"_b_{n}", f"_m_{n}") for n in maxima}
    return d.select(*rows.columns, *[c.alias(n) for n, c in found.items()])
