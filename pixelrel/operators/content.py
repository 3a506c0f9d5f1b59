"""Content figures of images, row filters and checksums: windows along rows, then aggregates combined before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADLER = 65521


def _row_step(least_up: bool) -> Column:
    """Every how many rows are looked at so that about half a million steps are: the number of rows wanted cut down, or rounded up."""
    per_row = F.greatest(F.col("w") - 1, F.lit(1))
    rows = F.ceil(F.lit(500_000) / per_row) if least_up else F.floor(F.lit(500_000) / per_row)
    return F.greatest(F.floor(F.col("h") / F.greatest(rows, F.lit(1))), F.lit(1)).cast("long")


def content_figures(pixels: DataFrame) -> DataFrame:
    """Per image: n, opaque and zero_alpha (shares), mean_step and var_step of the luma to the left on the rows looked at (and mean_step_up, var_step_up on
    those of the rounded-up choice), run_length of equal colours in row order, colours (distinct opaque ones; every fourth pixel above a million).

    Windows run along single rows. Runs that cross rows are joined at their ends: a row sends its first and last colour, so no image
    is gathered pixel by pixel in one task.
    """
    row = Window.partitionBy("image_id", "y").orderBy("x")
    colour = F.struct("r", "g", "b")
    d = pixels.withColumn("luma", F.expr("(r + g + b) div 3")).withColumn("c", colour)
    d = d.withColumn("step", F.abs(F.col("luma") - F.lag("luma").over(row))).withColumn("fresh", (F.col("c") != F.lag("c").over(row)).cast("int"))
    chosen = {"": F.col("y") % _row_step(False) == 0, "_up": F.col("y") % _row_step(True) == 0}
    sums = [F.sum(F.when(c, v)).alias(f"{n}{k}") for k, c in chosen.items() for n, v in (("s1", F.col("step")), ("s2", F.col("step") * F.col("step")), ("s0", F.when(F.col("step").isNotNull(), 1)))]
    rows = d.groupBy("image_id", "y").agg(
        F.count("*").alias("n"), F.count_if(F.col("a") == 255).alias("full"), F.count_if(F.col("a") == 0).alias("zero"), *sums,
        F.coalesce(F.sum("fresh"), F.lit(0)).alias("changes"), F.min_by("c", "x").alias("first"), F.max_by("c", "x").alias("last"))
    seam = (F.col("first") != F.lag("last").over(Window.partitionBy("image_id").orderBy("y"))).cast("int")
    both = rows.withColumn("seam", seam).groupBy("image_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "full", "zero", *[f"s{i}{k}" for k in chosen for i in range(3)])], (1 + F.sum("changes") + F.coalesce(F.sum("seam"), F.lit(0))).alias("runs"))
    seen = pixels.where("a = 255 and (w * h <= 1000000 or (y * w + x) % 4 = 0)").select("image_id", "r", "g", "b").distinct().groupBy("image_id").agg(F.count("*").alias("colours"))
    mean = {k: F.coalesce(F.col(f"s1{k}") / F.col(f"s0{k}"), F.lit(0.0)) for k in chosen}
    var = {k: F.coalesce(F.col(f"s2{k}") / F.col(f"s0{k}"), F.lit(0.0)) - mean[k] * mean[k] for k in chosen}
    return both.join(seen, "image_id", "left").select(
        "image_id", "n", (F.col("full") / F.col("n")).alias("opaque"), (F.col("zero") / F.col("n")).alias("zero_alpha"),
        *[m.alias(f"mean_step{k}") for k, m in mean.items()], *[v.alias(f"var_step{k}") for k, v in var.items()],
        (F.col("n") / F.col("runs")).alias("run_length"), F.coalesce("colours", F.lit(0)).cast("long").alias("colours"))


def is_gradient() -> Column:
    """Whether an image of at least 200,000 nearly all opaque pixels is extremely smooth and yet of many colours (columns of ``content_figures`` and w)."""
    return (F.col("n") >= 200_000) & (F.col("w") >= 2) & (F.col("opaque") >= 0.95) & (F.col("mean_step_up") < 1.0) & (F.col("colours") >= 1000)


def palette_size() -> Column:
    """Number of palette entries for an image: few for sparse translucent ones, most for sharp edges and rich smooth ones."""
    step, var, colours = F.col("mean_step"), F.col("var_step"), F.col("colours")
    clear = F.when(step > 5.0, 256).when(colours < 5_000, 32).when(colours < 25_000, 48).otherwise(64)
    rich = colours > 75_000
    smooth = ((step < 1.5) & (var < 20.0)) | ((step < 5.0) & (var < 150.0))
    return F.when(F.col("opaque") < 0.95, clear).when(rich & smooth, 256).when((colours > 100_000) & (var > 200.0), 192).otherwise(208)


def palette_and_importance() -> Column:
    """Struct (n, alpha): noisy images of very many colours get by with fewer entries chosen by importance."""
    n = palette_size()
    noisy = (n == 192) & (F.col("var_step") > 200.0)
    return F.struct(F.when(noisy, 144).otherwise(n).alias("n"), F.when(noisy, 0.5).otherwise(0.0).alias("alpha"))


def auto_dither() -> Column:
    return F.lit(0.0)


def tiered_dither() -> Column:
    """The earlier choice of a dither strength by tiers of size, transparency, runs, smoothness and colours."""
    runs, colours, step, var = F.col("run_length"), F.col("colours"), F.col("mean_step_up"), F.col("var_step_up")
    partial = 1 - F.col("opaque") - F.col("zero_alpha")
    clear = (
        F.when((partial >= 0.10) & (F.col("opaque") < 0.50), 0.7).when(partial >= 0.10, 0.35)
        .when(colours > 60_000, 0.85).when(colours > 20_000, 0.7).otherwise(0.5)
    )
    textured = F.when(runs > 2.0, 0.25).when((step > 5.0) & (step <= 7.5), 0.5).otherwise(0.7)
    full = (
        F.when((runs > 2.0) & (colours < 1000), 0.25).when(F.col("w") < 2, 0.5).when(step < 1.0, 0.7)
        .when(var > 50.0, textured).when(colours > 120_000, 0.7).otherwise(0.5)
    )
    return F.when(F.col("n") < 200_000, 0.0).when(F.col("opaque") < 0.95, clear).otherwise(full)


def first_dither() -> Column:
    """The first rule: opaque and large images are dithered at half strength."""
    return F.when((F.col("opaque") >= 0.95) & (F.col("n") >= 200_000), 0.5).otherwise(0.0)


#: Positions of a stream that one task looks at together.
STREAM_BLOCK = 1 << 16


def byte_run_length(bytes_: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Bytes and their mean run of equal values per key.

    Streams are cut into blocks of positions; a block sends its number of changes with its first and last value, and runs that cross blocks are joined at those.
    """
    d = bytes_.withColumn("_block", F.floor(F.col(position) / STREAM_BLOCK))
    fresh = (F.col(value) != F.lag(value).over(Window.partitionBy(key, "_block").orderBy(position))).cast("int")
    blocks = d.withColumn("_f", fresh).groupBy(key, "_block").agg(
        F.count("*").alias("_n"), F.coalesce(F.sum("_f"), F.lit(0)).alias("_changes"), F.min_by(value, position).alias("_first"), F.max_by(value, position).alias("_last"))
    seam = (F.col("_first") != F.lag("_last").over(Window.partitionBy(key).orderBy("_block"))).cast("int")
    return blocks.withColumn("_seam", seam).groupBy(key).agg(F.sum("_n").alias("n"), (F.sum("_n") / (1 + F.sum("_changes") + F.coalesce(F.sum("_seam"), F.lit(0)))).alias("run_length"))


def level() -> Column:
    """Compression level of a byte stream by its length ``n`` and ``run_length``: long flat and very flat ones are packed fast."""
    return F.when(((F.col("n") > 500_000) & (F.col("run_length") >= 8.0)) | (F.col("run_length") >= 32.0), "fast").otherwise("best")


def png_route(effort: Column) -> Column:
    """Struct (route, effort, preset, iterations) of automatic compression, from ``content_figures`` and w: gradients stay lossless, large ones at least effort.

    preset is the optimiser's: the effort where it is not the default 3, else 1 for 5 million pixels and more; iterations are those of exhaustive search, 0 below effort 7.
    """
    large = F.col("n") >= 5_000_000
    lossless = is_gradient()
    used = F.when(lossless & large & (effort == 5), 1).otherwise(effort)
    return F.struct(
        F.when(lossless, "lossless").otherwise("palette").alias("route"), used.cast("int").alias("effort"),
        optimiser_preset(F.least(used, F.lit(10)), large).alias("preset"), search_iterations(used).alias("iterations"))


def optimiser_preset(effort: Column, large: Column, default: int = 5) -> Column:
    return F.when(effort != default, F.least(effort, F.lit(6))).when(large, 1).otherwise(3).cast("int")


def search_iterations(effort: Column) -> Column:
    return F.when(effort >= 7, F.greatest(F.least((effort - 6) * 5, F.lit(30)), F.lit(1))).otherwise(0).cast("int")


def encoder_speed(effort: Column) -> Column:
    """1 (slowest) to 10 from an effort of 0 to 10."""
    return F.greatest(11 - F.least(effort, F.lit(10)), F.lit(1)).cast("int")


def unique_colour_ratio(pixels: DataFrame) -> DataFrame:
    """Distinct colours over pixels, from colours counted first, so that a plain image leaves a partition as one row."""
    counts = pixels.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))
    return counts.groupBy("image_id").agg((F.count("*") / F.sum("n")).alias("ratio"))


def _signed(residue: Column) -> Column:
    byte = F.pmod(residue, F.lit(256))
    return F.when(byte < 128, byte).otherwise(256 - byte)


def _guesses(left: Column, up: Column, corner: Column) -> list[Column]:
    """What each filter foretells: nothing, left, up, their mean, and the Paeth choice of the three."""
    to_left, to_up, to_corner = F.abs(up - corner), F.abs(left - corner), F.abs(left + up - 2 * corner)
    paeth = F.when((to_left <= to_up) & (to_left <= to_corner), left).when(to_up <= to_corner, up).otherwise(corner)
    return [F.lit(0), left, up, F.floor((left + up) / 2), paeth]


def _neighbours(pixels: DataFrame, channel: str) -> DataFrame:
    """(image_id, x, y, v, up, left, corner): a value and those beside it, 0 beyond the edges."""
    along, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    d = pixels.select("image_id", "x", "y", F.col(channel).alias("v"), F.coalesce(F.lag(channel).over(down), F.lit(0)).alias("up"))
    return d.withColumns({"left": F.coalesce(F.lag("v").over(along), F.lit(0)), "corner": F.coalesce(F.lag("up").over(along), F.lit(0))})


def _least() -> Column:
    return F.array_min(F.array(*[F.struct(F.col(f"s{i}").alias("sad"), F.lit(i).alias("filter")) for i in range(5)]))


def row_filters(pixels: DataFrame, channel: str) -> DataFrame:
    """Per image row the filter (0 none, 1 sub, 2 up, 3 average, 4 Paeth) of the least absolute sum, the lowest on ties."""
    guesses = _guesses(F.col("left"), F.col("up"), F.col("corner"))
    sums = _neighbours(pixels, channel).groupBy("image_id", "y").agg(*[F.sum(_signed(F.col("v") - g)).alias(f"s{i}") for i, g in enumerate(guesses)])
    return sums.select("image_id", "y", _least()["filter"].alias("filter"), _least()["sad"].alias("sad"))


def filtered_bytes(pixels: DataFrame, channel: str, chosen: DataFrame | None = None) -> DataFrame:
    """Bytes of each row after its ``chosen`` filter: (image_id, y, x, filter, byte). Without ``chosen`` it is that of ``row_filters``, found in the same pass by sums over the row."""
    d, guess = _neighbours(pixels, channel), _guesses(F.col("left"), F.col("up"), F.col("corner"))
    if chosen is None:
        row = Window.partitionBy("image_id", "y")
        d = d.withColumns({f"s{i}": F.sum(_signed(F.col("v") - g)).over(row) for i, g in enumerate(guess)}).withColumn("filter", _least()["filter"])
    else:
        d = d.join(chosen.select("image_id", "y", "filter"), ["image_id", "y"])
    picked = F.element_at(F.array(*[g.cast("long") for g in guess]), F.col("filter") + 1)
    return d.select("image_id", "y", "x", "filter", F.pmod(F.col("v") - picked, F.lit(256)).alias("byte"))


def filter_histogram(chosen: DataFrame) -> DataFrame:
    """Rows per image and chosen filter, and their percent of the image's rows."""
    counts = chosen.groupBy("image_id", "filter").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("image_id")))


def adler32(bytes_: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Adler-32 of byte relations with positions from 0, as sums that Spark combines map-side."""
    # Factors are reduced before they are multiplied, so a sum grows by less than 2^24 a byte.
    at = (F.col(position) % ADLER) * F.col(value)
    sums = bytes_.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(at).alias("ps"))
    low, n = (1 + F.col("s")) % ADLER, F.col("n") % ADLER
    high = F.pmod(n + n * (F.col("s") % ADLER) - F.col("ps") % ADLER, F.lit(ADLER))
    return sums.select(key, (high * 65536 + low).alias("adler32"))


def crc32_update(start: Column, values: Column) -> Column:
    """CRC-32 continued over an array of byte values from the CRC of what came before (0 at first)."""
    full = F.lit(0xFFFFFFFF).cast("long")
    table = F.array(*[F.lit(_crc_of(i)).cast("long") for i in range(256)])
    step = lambda c, v: F.shiftrightunsigned(c, 8).bitwiseXOR(F.element_at(table, c.bitwiseXOR(v).bitwiseAND(F.lit(255)).cast("int") + 1))
    return F.aggregate(values, start.cast("long").bitwiseXOR(full), step).bitwiseXOR(full)


def _crc_of(byte: int) -> int:
    for _ in range(8):
        byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def stored_size(length: Column) -> Column:
    """Bytes of ``length`` bytes in stored blocks of up to 65,535: five more each, one block at least."""
    return length + 5 * F.greatest(F.ceil(length / 65535), F.lit(1)).cast("long")


def match_symbols(length: Column, distance: Column) -> dict[str, Column]:
    """Symbol and extra bits of a match length (3 to 258) and distance (1 to 32,768): ranges double every four or two symbols."""
    def bucket(v: Column, per: int) -> tuple[Column, Column]:
        # v counts from 0: under 2 * per each value is its own bucket, then the top bits name the bucket.
        bits = F.floor(F.log2(F.greatest(v, F.lit(1)).cast("double") + 0.5)).cast("int")
        extra = F.greatest(bits - per, F.lit(0))
        return (F.when(v < 1 << (per + 1), v).otherwise(extra * (1 << per) + F.call_function("shiftright", v, extra))).cast("long"), extra.cast("long")

    (lb, le), (db, de) = bucket(length - 3, 2), bucket(distance - 1, 1)
    top = length == 258
    return {"length_symbol": F.when(top, 285).otherwise(257 + lb).cast("long"), "length_bits": F.when(top, 0).otherwise(le).cast("long"), "distance_symbol": db, "distance_bits": de}


def code_length_runs(lengths: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Run-length symbols of code lengths per key, in order: (key, start, place, symbol, extra, bits).

    ``start`` is the position of the run, ``place`` the symbol's number in it. Runs of zeros become 18 (11 to 138), then 17 (3 to 10) or plain zeros;
    others their value once, then 16 (3 to 6 repeats) or the plain value.
    """
    order = Window.partitionBy(key).orderBy(position)
    fresh = F.coalesce((F.col(value) != F.lag(value).over(order)).cast("int"), F.lit(1))
    d = lengths.withColumn("_run", fresh).withColumn("_run", F.sum("_run").over(order))
    runs = d.groupBy(key, "_run").agg(F.min(position).alias("start"), F.first(value).alias("v"), F.count("*").alias("n"))

    def symbol(s, extra, bits: int) -> Column:
        return F.struct(F.lit(s).cast("int").alias("symbol"), F.lit(extra).cast("int").alias("extra"), F.lit(bits).alias("bits"))

    plain, zero = symbol(F.col("v"), 0, 0), F.col("v") == 0
    left = F.when(zero, F.col("n") % 138).otherwise((F.col("n") - 1) % 6)
    whole = F.when(zero, F.floor(F.col("n") / 138)).otherwise(F.floor((F.col("n") - 1) / 6)).cast("int")
    full = F.when(zero, symbol(18, 127, 7)).otherwise(symbol(16, 3, 2))
    part = F.when(~zero, symbol(16, left - 3, 2)).when(left >= 11, symbol(18, left - 11, 7)).otherwise(symbol(17, left - 3, 3))
    rest = F.when(left >= 3, F.array(part)).otherwise(F.array_repeat(plain, left.cast("int")))
    symbols = F.concat(F.array_repeat(plain, F.when(zero, 0).otherwise(1)), F.array_repeat(full, whole), rest)
    return runs.select(key, "start", F.posexplode(symbols).alias("place", "s")).select(key, "start", "place", "s.*")
