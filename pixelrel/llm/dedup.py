"""Exact duplicates through counting quotient filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, stage, table

QUOTIENT_BITS = 12
MAP_BYTES = (1 << QUOTIENT_BITS) // 8
#: A fingerprint of at least one row in so many is hot: there are as many of those at most.
HOT_PARTS = 512
#: Fingerprints after which a partition hands out a filter and begins another; filters merge, so any number may come.
FILTER_ROWS = 1_000_000
#: Distinct fingerprints a block of the merged filter holds on average: one task merges one block at a time.
BLOCK_ROWS = 50_000
FILTER = "block int, occupied binary, run_ends binary, remainders array<long>, counts array<long>"


def _pack(blocks: np.ndarray, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """One counting quotient filter per block from slots sorted by (block, quotient, remainder).

    Remainders lie in slots in the order of their quotients. Bit i of ``occupied`` tells that quotient i has a run, bit j of
    ``run_ends`` that slot j ends one: together they give every slot its quotient back. ``counts`` holds each slot's counter. Where few quotients have
    runs, ``occupied`` lists them in two bytes each instead, so a filter's bytes follow its slots however many blocks it touches.
    """
    rows, edges = [], np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]]) if len(blocks) else [0]
    for lo, hi in zip(edges[:-1], edges[1:]):
        q = quotients[lo:hi]
        ends = np.append(q[1:] != q[:-1], True)
        runs = q[ends]
        if 2 * len(runs) < MAP_BYTES:
            occupied = runs.astype("<u2").tobytes()
        else:
            bits = np.zeros(1 << QUOTIENT_BITS, np.uint8)
            bits[runs] = 1
            occupied = np.packbits(bits).tobytes()
        rows.append((int(blocks[lo]), occupied, np.packbits(ends).tobytes(), remainders[lo:hi], counts[lo:hi]))
    return pd.DataFrame(rows, columns=["block", "occupied", "run_ends", "remainders", "counts"])


def _quotients(occupied: bytes, run_ends: bytes, slots: int) -> np.ndarray:
    """The quotient of each slot of a filter."""
    if len(occupied) < MAP_BYTES:
        runs = np.frombuffer(occupied, "<u2").astype(np.int64)
    else:
        runs = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8)))
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(run_ends, np.uint8), count=slots))
    return np.repeat(runs, np.diff(np.concatenate([[-1], ends])))


def _builder(block_bits: int):
    shift, low = np.uint64(64 - block_bits - QUOTIENT_BITS), np.uint64((1 << (64 - block_bits - QUOTIENT_BITS)) - 1)

    def filters(fps: np.ndarray) -> pd.DataFrame:
        fps, counts = np.unique(fps.astype(np.int64).view(np.uint64), return_counts=True)
        top = (fps >> shift).astype(np.int64)
        return _pack(top >> QUOTIENT_BITS, top & ((1 << QUOTIENT_BITS) - 1), (fps & low).astype(np.int64), counts.astype(np.int64))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(pdf["fp"].to_numpy())
            n += len(pdf)
            if n >= FILTER_ROWS:
                yield filters(np.concatenate(held))
                held, n = [], 0
        if n:
            yield filters(np.concatenate(held))

    return build


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The filters of one block merged by their sorted remainders, counters of equal fingerprints added."""
    sizes = [len(r) for r in pdf["remainders"]]
    quotient = np.concatenate([_quotients(o, e, n) for o, e, n in zip(pdf["occupied"], pdf["run_ends"], sizes)])
    remainder, count = (np.concatenate(list(pdf[c])).astype(np.int64) for c in ("remainders", "counts"))
    order = np.lexsort((remainder, quotient))
    quotient, remainder, count = quotient[order], remainder[order], count[order]
    first = np.flatnonzero(np.append(True, (quotient[1:] != quotient[:-1]) | (remainder[1:] != remainder[:-1])))
    block = np.full(len(first), pdf["block"].iloc[0])
    return _pack(block, quotient[first], remainder[first], np.add.reduceat(count, first))


def repeated_fingerprints(fingerprints: DataFrame, rows: int | None = None) -> DataFrame:
    """(fp, n) of the fingerprints counted more than once, from ``fingerprints`` (fp long).

    Each partition builds counting quotient filters, so a hot fingerprint leaves it as one counted remainder. A fingerprint's
    leading bits name its block, the next ones its quotient, the others are its remainder. Filters merge losslessly, block by block; the number of blocks
    follows the number of ``rows``, so a block fits a task at any size.
    """
    rows = fingerprints.count() if rows is None else rows
    bits = max(4, int(np.ceil(np.log2(max(rows, 1) / BLOCK_ROWS)))) if rows > BLOCK_ROWS else 4
    low = 64 - bits - QUOTIENT_BITS
    merged = fingerprints.select("fp").mapInPandas(_builder(bits), FILTER).groupBy("block").applyInPandas(_merge, FILTER)

    def repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                count, remainder = np.asarray(row.counts, np.int64), np.asarray(row.remainders, np.int64)
                hit = np.flatnonzero(count > 1)
                top = (row.block << QUOTIENT_BITS) | _quotients(row.occupied, row.run_ends, len(count))[hit]
                fp = (top.astype(np.uint64) << np.uint64(low)) | remainder[hit].astype(np.uint64)
                yield pd.DataFrame({"fp": fp.view(np.int64), "n": count[hit]})

    return merged.mapInPandas(repeats, "fp long, n long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty; of equal texts the largest doc_id stays (null ids
    lose; where an id is repeated inside a group each such row is kept). Fingerprints counted once need no more work. The others'
    texts are grouped by their own bytes: those of hot fingerprints, few enough to broadcast, stay where they are until their partition has combined them to one row a text, the
    others meet by fingerprint. Whole texts of any length are hashed and compared; extra columns are ignored, an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = stage(docs.select("doc_id", F.xxhash64(text).alias("fp"), F.sha2(text.cast("binary"), 256).alias("text_sha256")), "fingerprints")
    total = narrow.count()
    repeats = stage(repeated_fingerprints(narrow, total), "repeats")
    hot, few = (repeats.where(c).select("fp") for c in (F.col("n") * HOT_PARTS >= total, F.col("n") * HOT_PARTS < total))
    texts = docs.select("doc_id", text.alias("text")).withColumn("fp", F.xxhash64("text"))
    common = texts.join(F.broadcast(hot), "fp", "left_semi")
    rare = texts.join(F.broadcast(hot), "fp", "left_anti").join(few, "fp", "left_semi")
    verified = common.unionByName(rare).groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = stage(verified.select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    rows = attach(narrow.select("doc_id", "text_sha256"), groups, "text_sha256", "group_size", max(total, 1))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
