"""The training-data pipeline: each stage reads what its predecessor kept. All but the last, which returns pieces, return rows with the columns of their input.

Every stage takes a table with doc_id, text and source (mixing) and any other columns, whatever their names: a row travels as one struct beside the columns that a stage
works with. Null texts equal empty ones; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelrel.llm import dedup, mixing, packing, simhash, toxicity
from pixelrel.llm.common import stage, table

#: Near copies: shingles of five words, similarity 0.8. Candidates are up to 14 bits apart, as 0.8 means about 10 of 64.
NEAR_SHINGLE, NEAR_BITS, NEAR_SIMILARITY = 5, 14, 0.8


def _beside(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` and the whole row as ``_row``, so that no column of the table meets one of an operator."""
    return docs.select(*columns, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows not predicted toxic by the models fitted on the documents of this input that have labels.

    Repeated rows and equal texts fare alike; rows with a null id are scored, not learnt from; without labels all rows stay.
    """
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(_beside(docs, "text"), model).where("predicted = 0").select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest id of each group of equal texts.

    Ties: rows that share both text and id stay together. A null id loses against any other; rows of one text that all have none stay together.
    """
    keep = dedup.exact_groups(docs.select("doc_id", "text")).where("kept").select("doc_id", "text_sha256").distinct()
    return _only(docs, keep, {"doc_id": F.col("doc_id"), "text_sha256": F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)})


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component over texts whose 5-word shingles are as similar as 0.8.

    Rows are kept by id, null being one: of repeated ids, also with different texts, all stay if one does. A null id is the smallest only where its component has no other.
    Texts without words are alike.
    """
    found = simhash.simhash_components(docs.select("doc_id", "text"), shingle=NEAR_SHINGLE, bits=NEAR_BITS, verify=NEAR_SIMILARITY)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return _only(docs, keep, {"doc_id": F.col("doc_id")})


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated so that all sources weigh the same, in a global random order; a null source is that of empty name. Rows that are equal in id, source and text are repeated alike."""
    mixed = mixing.replicate(_beside(docs, "doc_id", "source", "text"))
    return mixing.shuffled(mixed.select("doc_id", "copy", "shuffle_key", "_row")).select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rows placed into sequences: (doc_id, piece, start, length, ids_crc32, sequence_id, offset). Repeated rows are packed each; ids are cast to long."""
    return packing.pack(packing.cut_pieces(docs.select("doc_id", "text")))


def _only(docs: DataFrame, keep: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose ``keys`` are in ``keep``; nulls are equal."""
    rows = _beside(docs, *[c.alias(f"_d_{n}") for n, c in keys.items()])
    keep = keep.select([F.col(n).alias(f"_k_{n}") for n in keys])
    same = [F.col(f"_d_{n}").eqNullSafe(F.col(f"_k_{n}")) for n in keys]
    return rows.join(keep, same, "left_semi").select("_row.*")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
