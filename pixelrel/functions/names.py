"""Names and formats of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension (any case) to format.
FORMATS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "webp": "webp", "gif": "gif", "bmp": "bmp", "tif": "tiff", "tiff": "tiff", "avif": "avif", "jxl": "jxl"}


def format_of(path: Column) -> Column:
    """Format by the path's extension; null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.when(F.lit(False), F.lit(None).cast("string"))
    for e, name in FORMATS.items():
        known = known.when(ext == e, name)
    return known


def shorten_left(name: Column, width: int) -> Column:
    """The last ``width`` characters, an ellipsis in place of what is cut."""
    return F.when(F.length(name) <= width, name).otherwise(F.concat(F.lit("…"), F.right(name, F.lit(width - 1))))


def derived_name(path: Column, suffix: str, ext: str) -> Column:
    """``stem.suffix.ext`` next to the input."""
    return F.concat(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), F.lit(f".{suffix}.{ext}"))


# Names of formats in a list, and formats that can be encoded.
ALIASES = {"png": "png", "jpeg": "jpeg", "jpg": "jpeg", "webp": "webp", "avif": "avif", "gif": "gif", "bmp": "bmp", "tiff": "tiff"}
# Extension of each format; the automatic choice has none.
EXTENSIONS = {"png": "png", "jpeg": "jpg", "webp": "webp", "gif": "gif", "bmp": "bmp", "tiff": "tiff", "avif": "avif", "jxl": "jxl", "auto": ""}


def _lookup(value: Column, table: dict[str, str]) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, name in table.items():
        found = found.when(value == key, name)
    return found


def extension_of(format_: Column) -> Column:
    return _lookup(format_, EXTENSIONS)


def parse_formats(text: Column) -> Column:
    """Struct (formats, error) of a comma-separated list: blanks and empty parts dropped, any case, aliases resolved; unknown or no names are an error."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    names = F.transform(parts, lambda p: _lookup(p, ALIASES))
    bad = F.get(F.filter(parts, lambda p: _lookup(p, ALIASES).isNull()), 0)
    error = F.when(bad.isNotNull(), F.concat(F.lit("unknown format: "), bad)).when(F.size(parts) == 0, "no format")
    return F.struct(F.when(error.isNull(), names).alias("formats"), error.alias("error"))


def compress_format(flag: Column, output: Column) -> Column:
    """Struct (format, error): the flag, else the format of the output's extension, else an error."""
    found = F.coalesce(flag, format_of(output))
    return F.struct(found.alias("format"), F.when(found.isNull(), "no format").alias("error"))


def compressed_path(path: Column, flag: Column, folder: Column | None = None, suffix: str = "min") -> Column:
    """``stem.suffix.ext`` next to the input or in ``folder``; the extension is the flag's, else the input's own, else png."""
    own = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    ext = F.coalesce(extension_of(flag), F.when(own != "", own), F.lit("png"))
    stem = F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")
    if folder is not None:
        stem = F.concat(folder, F.lit("/"), F.regexp_extract(stem, r"([^/]*)$", 1))
    return F.concat(stem, F.lit(f".{suffix}."), ext)


def encode_route(format_: Column) -> Column:
    """Struct (route, error) of an encoding request by format: automatic is invalid, JXL unsupported."""
    error = F.when(format_ == "auto", "invalid").when(format_ == "jxl", "unsupported format")
    route = F.when(format_.isin("gif", "bmp", "tiff"), "passthrough").when(error.isNull(), format_)
    return F.struct(route.alias("route"), error.alias("error"))


def parse_dither(text: Column) -> Column:
    """off is 0, auto NaN, a number itself; anything else is null."""
    return F.when(text.isin("off", "Off", "OFF"), 0.0).when(text.isin("auto", "Auto", "AUTO"), float("nan")).when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.expr("1D") * text.try_cast("double"))


def quality(lossless: Column, dssim: Column, ssim: Column, butteraugli: Column, q: Column) -> Column:
    """The first quality that is asked for: lossless, a target of one of three measures, a number; else automatic."""
    def of(kind: str, v: Column) -> Column:
        return F.concat_ws(":", F.lit(kind), v.cast("string"))

    return F.when(lossless, "lossless").when(dssim.isNotNull(), of("dssim", dssim)).when(ssim.isNotNull(), of("ssim", ssim)).when(
        butteraugli.isNotNull(), of("butteraugli", butteraugli)).when(q.isNotNull(), of("q", q)).otherwise("auto")
