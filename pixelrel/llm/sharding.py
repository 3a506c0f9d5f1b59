"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, stage, table


def shard_by_bytes(docs: DataFrame, shards: int = 16, parts: int | None = None) -> DataFrame:
    """Place rows into ``shards`` contiguous runs cut at equal byte targets, equal texts side by side.

    Groups of equal texts come in the order of their smallest doc_id, rows of a group in that of their own: a cut
    between two shards splits one group at most, so ``shards`` - 1 groups are split at most. Null texts equal empty ones.
    Only (doc_id, size, checksum, hash) is shuffled, never text. Rows are range-partitioned (ties and repeated rows
    dealt by a number given to each row, so that no id fills one partition), staged, and summed inside each
    partition; totals per partition (``parts`` rows; one per half a million rows, 64 at least) turn those into global prefix sums. A row belongs to the
    shard holding the middle byte of its own range. Null text counts one byte, null ids come first; an empty table gives
    an empty result.
    """
    parts = parts or max(64, -(-docs.count() // 500_000))
    narrow = stage(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash"),
        F.pmod(F.monotonically_increasing_id(), F.lit(100_003)).alias("deal"),
    ), "rows")
    # A struct's minimum keeps null ids, which come first.
    groups = narrow.groupBy("hash").agg(F.min(F.struct("doc_id")).alias("low"), F.count("*").alias("n")).where("n > 1")
    rows = attach(narrow, stage(groups, "groups"), "hash", "n", max(narrow.count(), 1))
    rows = rows.withColumn("low", F.when(F.col("low").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id"))).drop("n")
    ranged = stage(rows.repartitionByRange(parts, "low", "hash", "doc_id", "deal").withColumn("part", F.spark_partition_id()), "shards")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row per partition, at most `parts` of them: a single-task window over them is bounded.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_base"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_base"),
        F.sum("bytes").over(Window.partitionBy(F.lit(1))).alias("all_bytes"),
    )
    here = Window.partitionBy("part").orderBy("low", "hash", "doc_id", "deal", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(here)).withColumn("nth", F.count(F.lit(1)).over(here))
        .join(F.broadcast(base), "part")
        .withColumn("middle", 2 * (F.col("byte_base") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.least(F.expr(f"(middle * {shards}) div (2 * all_bytes)"), F.lit(shards - 1)).cast("int"))
        .withColumn("row", F.col("row_base") + F.col("nth"))
    )
    # Shards are contiguous, so a shard's slots start at the number of rows in the shards before it: `shards` rows at most.
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n"))
    starts = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - 1 - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


