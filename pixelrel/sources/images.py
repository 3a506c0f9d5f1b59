"""Images as relations of pixels (image_id, w, h, x, y, r, g, b, a): every image carries its own size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import format_of

EMB_RGBA_SQL = """
emb_img AS MATERIALIZED (
  SELECT vec_id AS image_id, CASE WHEN vec_id % 2 = 0 THEN CAST(8 AS BIGINT) ELSE CAST(16 AS BIGINT) END AS w,
    list_transform(embedding, lambda v: CAST(least(greatest(floor((CAST(v AS DOUBLE) + 1) * 127.5), 0), 255) AS BIGINT)) AS p FROM embeddings),
emb_rgba AS MATERIALIZED (
  SELECT image_id, w, 64 // w AS h, i % w AS x, i // w AS y, p[i + 1] AS r, p[(i + 16) % 64 + 1] AS g, p[(i + 32) % 64 + 1] AS b,
    CASE WHEN p[(i + 48) % 64 + 1] >= 128 THEN CAST(255 AS BIGINT) ELSE 2 * p[(i + 48) % 64 + 1] END AS a
  FROM (SELECT image_id, w, p, unnest(range(64)) AS i FROM emb_img))
"""


def emb_rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image per vector, 8x8 for even ids and 16x4 for odd ones; a row of `embeddings` becomes 64, without a shuffle."""
    grey = F.transform("embedding", lambda v: F.least(F.greatest(F.floor((v.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("long"))
    width = F.when(F.col("vec_id") % 2 == 0, 8).otherwise(16).cast("long")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), width.alias("w"), grey.alias("p"))
    pixels = vectors.select("image_id", "w", "p", F.posexplode("p").alias("i", "r"))

    def channel(shift: int):
        return F.element_at("p", (F.col("i") + shift) % 64 + 1)

    alpha = channel(48)
    return pixels.select(
        "image_id", "w", F.expr("64 div w").alias("h"), (F.col("i") % F.col("w")).alias("x"), F.expr("i div w").alias("y"), "r",
        channel(16).alias("g"), channel(32).alias("b"), F.when(alpha >= 128, F.lit(255)).otherwise(2 * alpha).cast("long").alias("a"),
    )


#: Vectors whose mosaics are built apart: a mosaic has as many tiles at most.
MOSAIC_BLOCK = 10_000
MOSAIC_SQL = f"""
tile AS MATERIALIZED (
  SELECT coalesce(label, -1) + 1000 * (vec_id // {MOSAIC_BLOCK}) AS image_id, row_number() OVER (PARTITION BY coalesce(label, -1), vec_id // {MOSAIC_BLOCK} ORDER BY vec_id) - 1 AS place,
    list_transform(embedding, lambda v: CAST(least(greatest(floor((CAST(v AS DOUBLE) + 1) * 127.5), 0), 255) AS BIGINT)) AS p FROM embeddings),
frame AS MATERIALIZED (SELECT image_id, CAST(ceil(sqrt(count(*))) AS BIGINT) AS across, count(*) AS n FROM tile GROUP BY image_id),
mosaic AS MATERIALIZED (
  SELECT image_id, 8 * across AS w, 8 * ((n + across - 1) // across) AS h, 8 * (place % across) + i % 8 AS x, 8 * (place // across) + i // 8 AS y,
    coalesce(p[i + 1], 0) AS r, coalesce(p[(i + 16) % 64 + 1], 0) AS g, coalesce(p[(i + 32) % 64 + 1], 0) AS b,
    CASE WHEN p[(i + 48) % 64 + 1] >= 128 THEN CAST(255 AS BIGINT) ELSE coalesce(2 * p[(i + 48) % 64 + 1], 0) END AS a
  FROM (SELECT *, unnest(range(64)) AS i FROM (SELECT *, unnest(range(across * ((n + across - 1) // across))) AS place FROM frame) LEFT JOIN tile USING (image_id, place)))
"""


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image per label and block of ids: its vectors as 8x8 tiles in the order of their ids, row by row in a near-square frame whose spare tiles are clear."""
    grey = F.transform("embedding", lambda v: F.least(F.greatest(F.floor((v.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("long"))
    image = F.coalesce(F.col("label"), F.lit(-1)) + 1000 * F.expr(f"vec_id div {MOSAIC_BLOCK}")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(image.cast("long").alias("image_id"), "vec_id", grey.alias("p"))
    # A window holds the vectors of one block at most.
    tiles = vectors.withColumn("place", (F.row_number().over(Window.partitionBy("image_id").orderBy("vec_id")) - 1).cast("long"))
    frames = tiles.groupBy("image_id").agg(F.ceil(F.sqrt(F.count("*"))).alias("across"), F.count("*").alias("n")).withColumn("down", F.expr("(n + across - 1) div across"))
    cells = frames.withColumn("place", F.explode(F.expr("sequence(0L, across * down - 1)"))).join(tiles.select("image_id", "place", "p"), ["image_id", "place"], "left")
    pixels = cells.withColumn("i", F.explode(F.expr("sequence(0, 63)")))

    def channel(shift: int) -> Column:
        return F.coalesce(F.element_at("p", (F.col("i") + shift) % 64 + 1), F.lit(0).cast("long"))

    return pixels.select(
        "image_id", (8 * F.col("across")).alias("w"), (8 * F.col("down")).alias("h"), F.expr("8 * (place % across) + i % 8").alias("x"), F.expr("8 * (place div across) + i div 8").alias("y"),
        channel(0).alias("r"), channel(16).alias("g"), channel(32).alias("b"), F.when(channel(48) >= 128, F.lit(255)).otherwise(2 * channel(48)).cast("long").alias("a"))


def scan(spark: SparkSession, folder: str, formats: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(path, format, length) of the files below ``folder`` whose extension is known (or among ``formats``), by path, ``limit`` at most.

    No file left is an error. Contents are not read.
    """
    known = format_of(F.col("path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", known.alias("format"), "length").where("format is not null")
    if formats:
        files = files.where(F.col("format").isin(formats))
    files = files.orderBy("path")
    files = files if limit is None else files.limit(limit)
    if files.isEmpty():
        raise ValueError(f"no images in {folder}")
    return files


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of all files below ``folder``, bytes and all; file is the path. Spark's reader passes over files of no bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("file"), "content")


#: How files of each format start, in hexadecimal; RIFF files name theirs at offset 8.
SIGNATURES = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "474946383", "bmp": "424D", "tiff": "49492A00", "tiff_big": "4D4D002A"}


def identify(files: DataFrame) -> DataFrame:
    """(file, format, w, h, error) of ``files`` (file, content) by their first bytes, whatever their names.

    Sizes are those in the headers of png, gif and bmp files, null for others; bytes that no format starts with, or that end before such a header does, are a row with the error "codec", as null and empty contents are.
    """
    start = F.hex(F.substring("content", 1, 32))
    number = lambda at, n: F.conv(F.substring(start, 2 * at + 1, 2 * n), 16, 10).cast("long")
    # Little-endian numbers: their bytes in reverse.
    turned = lambda at, n: F.conv(F.concat(*[F.substring(start, 2 * (at + k) + 1, 2) for k in reversed(range(n))]), 16, 10).cast("long")
    format_ = F.when(F.substring(start, 1, 8).eqNullSafe("52494646") & (F.substring(start, 17, 8) == "57454250"), "webp")
    for name, sign in SIGNATURES.items():
        format_ = format_.when(start.startswith(sign), name.removesuffix("_big"))
    least = F.when(F.col("format") == "png", 24).when(F.col("format") == "gif", 10).when(F.col("format") == "bmp", 26).otherwise(0)
    d = files.withColumn("format", format_).withColumn("good", F.coalesce(F.col("format").isNotNull() & (F.length("content") >= least), F.lit(False)))
    sized = {"png": (number(16, 4), number(20, 4)), "gif": (turned(6, 2), turned(8, 2)), "bmp": (turned(18, 4), turned(22, 4))}
    side = lambda k: F.coalesce(*[F.when(F.col("good") & (F.col("format") == n), v[k]) for n, v in sized.items()])
    return d.select("file", F.when(F.col("good"), F.col("format")).alias("format"), side(0).alias("w"), side(1).alias("h"), F.when(~F.col("good"), "codec").alias("error"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, w, h, rgba) of the images Spark can decode by their content; image_id is the path. What it cannot decode has a null size.

    Spark gives bytes as BGR or BGRA (or one grey byte) per pixel; alpha is full where there is none.
    """
    rows = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder).select("image.*")
    good = F.col("width") > 0
    return rows.select(F.col("origin").alias("image_id"), *[F.when(good, F.col(c)).cast("long").alias(a) for c, a in (("width", "w"), ("height", "h"))],
                       F.when(good, F.col("nChannels")).alias("channels"), F.when(good, F.col("data")).alias("data"))


def to_pixels(images: DataFrame) -> DataFrame:
    """Pixels of ``read_images``: each image becomes its rows of bytes, each row its pixels; nothing is shuffled. Undecoded ones have none."""
    row = F.substring(F.col("data"), (F.col("y") * F.col("w") * F.col("channels") + 1).cast("int"), (F.col("w") * F.col("channels")).cast("int"))
    rows = images.where("w is not null").withColumn("y", F.explode(F.expr("sequence(0L, h - 1)"))).select("image_id", "w", "h", "channels", "y", F.hex(row).alias("line"))
    cells = rows.withColumn("x", F.explode(F.expr("sequence(0L, w - 1)")))

    def byte(k: int) -> Column:
        return F.conv(F.substring(F.col("line"), (2 * (F.col("x") * F.col("channels") + k) + 1).cast("int"), F.lit(2)), 16, 10).cast("long")

    grey = F.col("channels") == 1
    red, green = F.when(grey, byte(0)).otherwise(byte(2)), F.when(grey, byte(0)).otherwise(byte(1))
    return cells.select("image_id", "w", "h", "x", "y", red.alias("r"), green.alias("g"), byte(0).alias("b"), F.when(F.col("channels") == 4, byte(3)).otherwise(255).cast("long").alias("a"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(name, baseline_bytes) of a baseline file: a JSON object with the map ``fixtures`` of name to {"tinypng_bytes"}."""
    return baseline_rows(spark.read.text(path, wholetext=True).select("value"))


def baseline_rows(texts: DataFrame) -> DataFrame:
    parsed = texts.select(F.from_json("value", "fixtures map<string,struct<tinypng_bytes:bigint>>").alias("j"))
    return parsed.select(F.explode("j.fixtures").alias("name", "v")).select("name", F.col("v.tinypng_bytes").alias("baseline_bytes"))
