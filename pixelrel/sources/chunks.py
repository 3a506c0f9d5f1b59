"""Chunks of PNG files as rows: a walk along the lengths inside each file, and what the chunks say of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import settled

SIGNATURE = "89504E470D0A1A0A"
#: Chunks found in one pass over a file; a file of more is taken up again where the pass ended.
BLOCK = 512
#: Bytes of a reassembled stream at most.
STREAM_BOUND = 1 << 30


def _number(data: Column, at: Column) -> Column:
    """The big-endian number of four bytes at offset ``at``."""
    return F.conv(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(4))), 16, 10).cast("long")


def _name(data: Column, at: Column) -> Column:
    """Four bytes as ASCII, others as U+FFFD."""
    return F.regexp_replace(F.decode(F.substring(data, (at + 1).cast("int"), F.lit(4)), "ISO-8859-1"), "[^\\x00-\\x7F]", "�")


def _pass(files: DataFrame, block: int, stop: str | None) -> DataFrame:
    """Offsets ``found`` of up to ``block`` chunks of each file from ``pos`` on, and the ``pos`` after them: -1 behind a chunk of type ``stop``."""
    data, size = F.col("content"), F.length("content")

    def step(state: Column, _: Column) -> Column:
        at = state["pos"]
        after = at + 12 + _number(data, at)
        if stop is not None:
            after = F.when(F.substring(data, (at + 5).cast("int"), F.lit(4)) == F.lit(stop.encode()), F.lit(-1).cast("long")).otherwise(after)
        return F.when((at >= 0) & (at + 12 <= size), F.struct(after.alias("pos"), F.array_append(state["found"], at).alias("found"))).otherwise(state)

    steps = F.sequence(F.lit(1), F.greatest(F.least(F.lit(block), F.expr("int((length(content) - pos) div 12)")), F.lit(1)))
    first = F.struct("pos", F.array().cast("array<bigint>").alias("found"))
    return files.withColumn("s", F.aggregate(steps, first, step)).select("file", "content", "seen", "s.*")


def walk_chunks(files: DataFrame, stop: str | None = "IEND", block: int = BLOCK) -> DataFrame:
    """(file, colour_type, chunk_no, type, start, length, error) of ``files`` (file, content), a row per chunk in the order of the file.

    A chunk is a length, a type, that many bytes from ``start`` on, and four bytes more. The walk ends with a chunk of type ``stop`` (None: at the end of the file), where fewer than
    12 bytes are left, or with a chunk that runs beyond the file (error "overrun"). A file with another signature, or null, has one row without a chunk (error "signature"); one with
    the signature alone has none. colour_type is the byte at offset 25, null where the file is shorter. File names are unique. Each pass finds ``block`` chunks of a file at most, so memory does not follow their number; only files
    with more are read again.
    """
    size, signed = F.length("content"), F.hex(F.substring("content", 1, 8)) == SIGNATURE
    colour = F.when(size > 25, F.conv(F.hex(F.substring("content", 26, 1)), 16, 10).cast("long")).alias("colour_type")
    bad, none = F.coalesce(~signed, F.lit(True)), {"chunk_no": "long", "type": "string", "start": "long", "length": "long"}
    out = files.where(bad).select("file", colour, *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit("signature").alias("error"))
    todo, length = files.where(~bad).select("file", "content", F.lit(8).cast("long").alias("pos"), F.lit(0).cast("long").alias("seen")), _number(F.col("content"), F.col("at"))
    while True:
        # What was found is written, without the contents; a file taken up again is read from where it came.
        passed = _pass(todo, block, stop).withColumns({"more": (F.col("pos") >= 0) & (F.col("pos") + 12 <= size), "n": F.size("found")})
        rows = passed.select("file", "content", "pos", "seen", "more", "n", F.posexplode_outer("found").alias("i", "at"))
        now = settled(rows.select(
            "file", colour, (F.col("seen") + F.col("i")).alias("chunk_no"), _name(F.col("content"), F.col("at") + 4).alias("type"), (F.col("at") + 8).alias("start"), length.alias("length"),
            F.when(F.col("at") + 12 + length > size, "overrun").alias("error"), "pos", (F.col("seen") + F.col("n")).alias("seen"), (F.col("more") & (F.coalesce("i", F.lit(0)) == 0)).alias("more")))
        out = out.unionByName(now.where("chunk_no is not null").select(out.columns))
        left = now.where("more").select("file", "pos", "seen")
        if left.isEmpty():
            return out
        todo = files.select("file", "content").join(left, "file")


def chunk_figures(chunks: DataFrame) -> DataFrame:
    """Per file of ``walk_chunks``: colour_type, palette (entries of the first PLTE), transparency (length of the first tRNS), idat (bytes of all IDAT), chunks, error (the first found)."""
    first = lambda kind: F.min_by(F.when(F.col("type") == kind, F.col("length")), F.when(F.col("type") == kind, F.col("chunk_no")))
    zero = F.lit(0).cast("long")
    return chunks.groupBy("file").agg(
        F.max("colour_type").alias("colour_type"), F.coalesce(F.floor(first("PLTE") / 3), zero).alias("palette"), F.coalesce(first("tRNS"), zero).alias("transparency"),
        F.coalesce(F.sum(F.when(F.col("type") == "IDAT", F.col("length"))), zero).alias("idat"), F.count("chunk_no").alias("chunks"), F.min("error").alias("error"))


def stream_of(files: DataFrame, chunks: DataFrame, kind: str = "IDAT", bound: int = STREAM_BOUND) -> DataFrame:
    """(file, size, stream, error): the bytes of all chunks of ``kind`` of a file in their order, as one value; file names are unique.

    Pieces leave the files as rows and meet by file. A stream beyond ``bound`` bytes is not put together (error "too large"), one with an overrun chunk neither
    (error "overrun"); a file without such chunks has an empty one.
    """
    wanted = F.col("type") == kind
    sums = chunks.groupBy("file").agg(F.coalesce(F.sum(F.when(wanted, F.col("length"))), F.lit(0).cast("long")).alias("size"), F.min("error").alias("error"))
    sums = sums.withColumn("error", F.coalesce("error", F.when(F.col("size") > bound, "too large")))
    own = chunks.where(wanted).join(sums.where("error is null"), "file", "left_semi").select("file", "chunk_no", "start", "length")
    piece = F.substring(F.col("content"), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    pieces = own.join(files.select("file", "content"), "file").select("file", "chunk_no", F.hex(piece).alias("h"))
    joined = pieces.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "h"))).alias("p")).select("file", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("stream"))
    return sums.join(joined, "file", "left").select("file", "size", F.when(F.col("error").isNull(), F.coalesce("stream", F.lit(b""))).alias("stream"), "error")
