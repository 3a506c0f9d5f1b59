"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

SEED = 17
BROADCAST_SOURCES, BROADCAST_VALUES = 20_000, 2_000_000


def poisson_window(rate: float) -> tuple[int, list[float]]:
    """First count k of a window and P(X <= k) for the counts in it: what lies outside is under double precision.

    The window spans about ten deviations to both sides of the mean, so its size grows with the square root of ``rate``.
    """
    if rate <= 0:
        return 0, [1.0]
    reach = 10 * math.sqrt(rate) + 40
    low = max(0, math.floor(rate - reach))
    k = np.arange(low, math.ceil(rate + reach) + 1)
    steps = np.concatenate([[low * math.log(rate) - rate - math.lgamma(low + 1)], np.log(rate) - np.log(k[1:])])
    share = np.exp(np.cumsum(steps)).cumsum()
    return low, np.minimum(share / share[-1], 1.0).tolist()


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated a Poisson number of times, plus rate, copy (from 0) and shuffle_key.

    The mean is ``epochs * all rows * weight(source) / rows(source)``; without ``weights`` all sources weigh the same, sources not
    named get none. A null source is a source of its own, named "". The uniform number behind a count is a hash of (seed, doc_id, source, text), so a
    rerun repeats it, and exact repeats of a row agree. Null texts and ids hash as nothing; long texts are hashed whole; an empty table gives an
    empty result. Counts per source are combined map-side. The table of sources is
    broadcast only up to ``BROADCAST_SOURCES`` rows and ``BROADCAST_VALUES`` steps of their distributions; beyond that it is joined by shuffle, documents salted so that no
    source fills one task. Clashing column names are replaced. Sort by shuffle_key for the global order.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    counts = docs.groupBy(source.alias("_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        counts = counts.withColumn("_w", F.lit(1.0))
    else:
        spark = docs.sparkSession
        named = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "_source string, _w double")
        counts = counts.join(named, "_source", "left").fillna(0.0, ["_w"])
    totals = counts.agg(F.count("*"), F.sum("_n"), F.sum("_w")).first()
    rate = F.lit(float(epochs)) * F.lit(float(totals[1] or 0)) * F.col("_w") / F.lit(float(totals[2] or 1.0)) / F.col("_n")

    @F.pandas_udf("low long, cdf array<double>")
    def window(rates: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([poisson_window(r) for r in rates], columns=["low", "cdf"])

    plan = counts.select("_source", rate.alias("rate")).withColumn("_w", window("rate")).select("_source", "rate", F.col("_w.low").alias("_low"), F.col("_w.cdf").alias("_cdf"))
    plan = stage(plan, "rates")
    held = plan.agg(F.count("*"), F.sum(F.size("_cdf"))).first()
    rows = docs.drop("rate", "copy", "shuffle_key").withColumn("_source", source)
    if held[0] <= BROADCAST_SOURCES and (held[1] or 0) <= BROADCAST_VALUES:
        joined = rows.join(F.broadcast(plan), "_source")
    else:
        salts = 64
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        joined = rows.join(plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["_source", "_salt"]).drop("_salt")
    word = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_source"), F.col("text"))
    uniform = F.shiftrightunsigned(word, 11).cast("double") / F.lit(float(1 << 53))
    times = F.col("_low") + F.size(F.filter("_cdf", lambda c: c <= uniform))
    return (
        joined.withColumn("_times", times).where("_times > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
        .withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("copy"), F.xxhash64("text")))
        .drop("_source", "_low", "_cdf", "_times")
    )


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` in the global order of shuffle_key: range-partitioned and sorted within partitions."""
    return rows.repartitionByRange("shuffle_key", "doc_id").sortWithinPartitions("shuffle_key", "doc_id", "copy")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = replicate(table(spark, sf_dir, "documents"))
    return shuffled(mixed.select("doc_id", "source", "rate", "copy", "shuffle_key"))
