"""All queries of the image and byte operators, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import names
from ..operators import analytics, content, geometry, metrics, pixels, tones
from ..sources import images
from ..sources.images import EMB_RGBA_SQL, emb_rgba

QUERIES: dict = {}
SQL: dict = {}


def _image(name: str, make, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(emb_rgba(spark, sf_dir))
    SQL[name] = f"WITH {EMB_RGBA_SQL} {sql}"


def _rounded(df, *columns: str, to: int = 6):
    return df.withColumns({c: F.round(c, to) + F.lit(0.0) for c in columns})


def _num(v: float) -> str:
    return f"CAST({v:.17e} AS DOUBLE)"


def _long(v: str) -> str:
    return f"CAST({v} AS BIGINT)"


def _clamp(v: str) -> str:
    return _long(f"least(greatest({v}, 0), 255)")


_RGB, _RGBA = ["r", "g", "b"], ["r", "g", "b", "a"]
_CH = ", ".join(_RGBA)
_ID = f"image_id, w, h, x, y, {_CH}"

# ---- geometry -------------------------------------------------------------------------------------------------------------------


def _nearest_sql(tw: str, th: str, source: str = "emb_rgba") -> str:
    return (f"(SELECT p.image_id, c.tw AS w, c.th AS h, c.i AS x, c.j AS y, {', '.join('p.' + c for c in _RGBA)} FROM (SELECT *, unnest(range(th)) AS j FROM (SELECT *, unnest(range(tw)) AS i FROM "
            f"(SELECT DISTINCT image_id, w, h, {tw} AS tw, {th} AS th FROM {source}))) c JOIN {source} p ON p.image_id = c.image_id AND p.x = ((2 * c.i + 1) * c.w) // (2 * c.tw) AND p.y = ((2 * c.j + 1) * c.h) // (2 * c.th))")


def _size_sql(mode: str, bw: int, bh: int) -> tuple[str, str]:
    pick = "greatest" if mode in ("cover", "outside") else "least"
    r = f"{pick}({bw}e0 / CAST(w AS DOUBLE), {bh}e0 / CAST(h AS DOUBLE))"
    out = [_long(f"greatest(round(CAST({c} AS DOUBLE) * {r}), 1)") for c in "wh"]
    if mode in ("inside", "outside"):
        keep = f"w <= {bw} AND h <= {bh}" if mode == "inside" else f"w >= {bw} AND h >= {bh}"
        out = [f"CASE WHEN {keep} THEN {c} ELSE {s} END" for c, s in zip("wh", out)]
    return out[0], out[1]


def _pad_sql(source: str, bw: int, bh: int, bg: tuple) -> str:
    whole = f"(p.a * 255 + {bg[3]} * (255 - p.a))"
    mix = [f"CASE WHEN p.image_id IS NULL THEN {v} WHEN {whole} = 0 THEN {v} ELSE (p.{c} * p.a * 255 + {v * bg[3]} * (255 - p.a)) // greatest({whole}, 1) END AS {c}" for c, v in zip("rgb", bg)]
    return (f"SELECT d.image_id, CAST({bw} AS BIGINT) AS w, CAST({bh} AS BIGINT) AS h, i AS x, j AS y, {', '.join(mix)}, CASE WHEN p.image_id IS NULL THEN {bg[3]} ELSE {whole} // 255 END AS a "
            f"FROM (SELECT DISTINCT image_id, greatest({bw} - w, 0) // 2 AS dx, greatest({bh} - h, 0) // 2 AS dy FROM {source}) d CROSS JOIN range({bw}) u(i) CROSS JOIN range({bh}) v(j) "
            f"LEFT JOIN {source} p ON p.image_id = d.image_id AND p.x + d.dx = i AND p.y + d.dy = j")


def _center_sql(source: str, bw: int, bh: int) -> str:
    return (f"SELECT image_id, cw AS w, ch AS h, x - (w - cw) // 2 AS x, y - (h - ch) // 2 AS y, {_CH} FROM (SELECT *, least(w, {bw}) AS cw, least(h, {bh}) AS ch FROM {source}) "
            "WHERE x - (w - cw) // 2 BETWEEN 0 AND cw - 1 AND y - (h - ch) // 2 BETWEEN 0 AND ch - 1")


_SIZES = [("width", 7, None), ("height", 6, None), ("exact", 5, 9), ("scale", 1.7, None)]
QUERIES["g01_resize_target"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select(
    "doc_id", *[c.alias(f"{m}_{s}") for m, a, b in _SIZES for s, c in zip("wh", geometry.target_size(m, a, b, F.col("n_chars"), F.col("doc_id")))])
SQL["g01_resize_target"] = (
    "SELECT doc_id, CAST(7 AS BIGINT) AS width_w, greatest(7 * doc_id // greatest(n_chars, 1), 1) AS width_h, greatest(6 * n_chars // greatest(doc_id, 1), 1) AS height_w, CAST(6 AS BIGINT) AS height_h, "
    "CAST(5 AS BIGINT) AS exact_w, CAST(9 AS BIGINT) AS exact_h, CAST(greatest(round(CAST(n_chars AS DOUBLE) * 1.7e0), 1) AS BIGINT) AS scale_w, CAST(greatest(round(CAST(doc_id AS DOUBLE) * 1.7e0), 1) AS BIGINT) AS scale_h FROM documents")
_image("g02_resize_nearest", lambda p: geometry.resize_nearest(p, geometry.target_size("scale", 1.4)),
       f"SELECT * FROM {_nearest_sql('CAST(round(w * 1.4e0) AS BIGINT)', 'CAST(round(h * 1.4e0) AS BIGINT)')}")

_KERNEL_SQL = {
    "triangle": ("greatest(1 - abs(t), 0e0)", 1.0),
    "catmullrom": ("CASE WHEN abs(t) < 1 THEN (1.5e0 * abs(t) - 2.5e0) * abs(t) * abs(t) + 1 WHEN abs(t) < 2 THEN ((2.5e0 - 0.5e0 * abs(t)) * abs(t) - 4) * abs(t) + 2 ELSE 0 END", 2.0),
    "gaussian": ("exp(-t * t / 0.5e0)", 3.0),
    "lanczos3": (f"CASE WHEN t = 0 THEN 1 WHEN abs(t) < 3 THEN 3 * sin(t * {_num(math.pi)}) * sin(t * {_num(math.pi)} / 3) / (t * {_num(math.pi)} * t * {_num(math.pi)}) ELSE 0 END", 3.0),
}


def _resample_sql(source: str, tw: str, th: str, weight: str, support: float, premultiply: bool = True) -> str:
    """Both axes at once: every target pixel over the whole source image, weights normalised along each axis."""
    share = "p.a / 255e0" if premultiply else "1e0"

    def axis(side: str, target: str) -> str:
        return (f"(SELECT n, m, i, k, {weight} AS q FROM (SELECT n, m, i, k, (k + 0.5e0 - (i + 0.5e0) * CAST(n AS DOUBLE) / m) / greatest(CAST(n AS DOUBLE) / m, 1e0) AS t FROM (SELECT *, unnest(range(n)) AS k FROM "
                f"(SELECT *, unnest(range(m)) AS i FROM (SELECT DISTINCT {side} AS n, {target} AS m FROM {source})))) WHERE abs(t) < {support})")

    one = ", ".join(f"sum(q * {v}) / sum(q) AS {c}" for c, v in [*[(c, f"p.{c} * {share}") for c in _RGB], ("a", "p.a")])
    two = ", ".join(f"sum(q * p.{c}) / sum(q) AS {c}" for c in _RGBA)
    byte = lambda v: _clamp(f"floor({v} + 0.5e0 + 1e-6)")
    back = [byte(f"CASE WHEN a > 0 THEN {c} * 255 / a ELSE 0 END" if premultiply else c) + f" AS {c}" for c in _RGB]
    return (f"(SELECT image_id, tw AS w, th AS h, x, y, {', '.join(back)}, {byte('a')} AS a FROM (SELECT p.image_id, p.tw, p.th, p.x, v.i AS y, {two} FROM "
            f"(SELECT p.image_id, p.w, p.h, p.tw, p.th, u.i AS x, p.y, {one} FROM (SELECT *, {tw} AS tw, {th} AS th FROM {source}) p JOIN {axis('w', tw)} u ON u.n = p.w AND u.m = p.tw AND u.k = p.x GROUP BY ALL) p "
            f"JOIN {axis('h', th)} v ON v.n = p.h AND v.m = p.th AND v.k = p.y GROUP BY ALL))")


for _k, (_name, _target, _sql) in {
    "triangle": ("g03_resize_triangle", ("exact", 5, 6), ("CAST(5 AS BIGINT)", "CAST(6 AS BIGINT)")), "catmullrom": ("g04_resize_catmull_rom", ("exact", 11, 7), ("CAST(11 AS BIGINT)", "CAST(7 AS BIGINT)")),
    "gaussian": ("g05_resize_gaussian", ("exact", 6, 9), ("CAST(6 AS BIGINT)", "CAST(9 AS BIGINT)")), "lanczos3": ("g06_resize_lanczos3", ("exact", 5, 3), ("CAST(5 AS BIGINT)", "CAST(3 AS BIGINT)")),
}.items():
    _image(_name, lambda p, k=_k, t=_target: geometry.resize(p, geometry.target_size(*t), k), "SELECT * FROM " + _resample_sql("emb_rgba", *_sql, *_KERNEL_SQL[_k]))

_BG = (9, 8, 7, 200)
_image("g07_fit_contain", lambda p: geometry.fit(p, "contain", (10, 6), _BG, "nearest"), f", s AS MATERIALIZED {_nearest_sql(*_size_sql('contain', 10, 6))} {_pad_sql('s', 10, 6, _BG)}")
_image("g08_fit_cover", lambda p: geometry.fit(p, "cover", (10, 6), kernel="nearest"), f", s AS MATERIALIZED {_nearest_sql(*_size_sql('cover', 10, 6))} {_center_sql('s', 10, 6)}")
_image("g09_fit_fill", lambda p: geometry.fit(p, "fill", (12, 6), kernel="nearest"), f"SELECT * FROM {_nearest_sql('CAST(12 AS BIGINT)', 'CAST(6 AS BIGINT)')}")
_image("g10_fit_inside", lambda p: geometry.fit(p, "inside", (12, 12), kernel="nearest"), f"SELECT * FROM {_nearest_sql(*_size_sql('inside', 12, 12))}")
_image("g11_fit_outside", lambda p: geometry.fit(p, "outside", (8, 8), kernel="nearest"), f"SELECT * FROM {_nearest_sql(*_size_sql('outside', 8, 8))}")
_image("g12_pad", lambda p: geometry.pad(p, (11, 10), _BG), _pad_sql("emb_rgba", 11, 10, _BG))
_image("g13_crop_center", lambda p: geometry.crop_center(p, (4, 5)), _center_sql("emb_rgba", 4, 5))
_image("g14_crop", lambda p: geometry.crop(p, 2, -1, 7, 6),
       f"SELECT image_id, least(w, 9) - 2 AS w, least(h, 5) AS h, x - 2 AS x, y, {_CH} FROM emb_rgba WHERE x >= 2 AND x < least(w, 9) AND y < least(h, 5)")
_APART = "sqrt((x + 0.5e0 - w / 2e0) * (x + 0.5e0 - w / 2e0) + (y + 0.5e0 - h / 2e0) * (y + 0.5e0 - h / 2e0))"
_image("g15_circle_mask", lambda p: geometry.circle_mask(p, None, 3.0),
       f"SELECT image_id, w, h, x, y, r, g, b, CAST(round(a * CASE WHEN d <= i THEN 1e0 WHEN d >= o THEN 0e0 ELSE (o - d) / greatest(o - i, 1e-6) END) AS BIGINT) AS a "
       f"FROM (SELECT *, least(w, h) / 2e0 AS o, greatest(least(w, h) / 2e0 - 3, 0e0) AS i, {_APART} AS d FROM emb_rgba)")
_image("g16_alpha_bbox", lambda p: pixels.alpha_bbox(p, 128),
       "SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM emb_rgba WHERE a > 128 GROUP BY image_id")
_image("g17_tile_2x2", geometry.tile_2x2, f"SELECT image_id, 2 * w AS w, 2 * h AS h, x + w * i AS x, y + h * j AS y, {_CH} FROM emb_rgba, range(2) u(i), range(2) v(j)")
_image("g18_flip_vertical", pixels.flip_vertical, f"SELECT image_id, w, h, x, h - 1 - y AS y, {_CH} FROM emb_rgba")
_image("flip_horizontal", pixels.flip_horizontal, f"SELECT image_id, w, h, w - 1 - x AS x, y, {_CH} FROM emb_rgba")
_image("g19_concat_vertical", lambda p: geometry.concat_vertical(p, pixels.invert(p)),
       f"SELECT image_id, w, 2 * h AS h, x, y, {_CH} FROM emb_rgba UNION ALL SELECT image_id, w, 2 * h, x, y + h, 255 - r, 255 - g, 255 - b, a FROM emb_rgba")
_image("g20_size_figures", geometry.size_figures, "SELECT DISTINCT image_id, w * h AS area, w / greatest(h, 1) AS aspect, w = 0 OR h = 0 AS is_empty FROM emb_rgba")
_image("m03_downscale_by_2", lambda p: geometry.downscale_by_2(geometry.crop(p, 0, 0, 7, 3)),
       "SELECT image_id, CAST(4 AS BIGINT) AS w, CAST(2 AS BIGINT) AS h, i AS x, j AS y, " + ", ".join(f"sum({c}) / 4e0 AS {c}" for c in _RGB)
       + " FROM (SELECT p.*, i, j FROM range(4) u(i), range(2) v(j), range(2) s(k), range(2) t(l), emb_rgba p WHERE p.x = least(2 * i + k, 6) AND p.y = least(2 * j + l, 2)) GROUP BY image_id, i, j")

# ---- tones ----------------------------------------------------------------------------------------------------------------------

_image("f01_grayscale", tones.grayscale, "SELECT image_id, w, h, x, y, (2126 * r + 7152 * g + 722 * b) // 10000 AS luma, a FROM emb_rgba")
_image("f02_invert", pixels.invert, "SELECT image_id, w, h, x, y, 255 - r AS r, 255 - g AS g, 255 - b AS b, a FROM emb_rgba")
_image("f03_gaussian_blur", lambda p: tones.gaussian_blur(p, 1.2), "SELECT * FROM " + _resample_sql("emb_rgba", "w", "h", f"exp(-t * t / {_num(2 * 1.2 * 1.2)})", 2.4, False))
_image("f04_unsharp", lambda p: tones.unsharp(p, 1.5, 1),
       f", s AS MATERIALIZED {_resample_sql('emb_rgba', 'w', 'h', 'exp(-t * t / 4.5e0)', 3.0, False)} SELECT image_id, w, h, x, y, "
       + ", ".join(f"CASE WHEN abs(p.{c} - s.{c}) > 1 THEN {_clamp(f'2 * p.{c} - s.{c}')} ELSE p.{c} END AS {c}" for c in _RGBA) + " FROM emb_rgba p JOIN s USING (image_id, w, h, x, y)")
_image("f05_brightness", lambda p: tones.brightness(p, -20.5), "SELECT image_id, w, h, x, y, " + ", ".join(f"{_clamp(c + ' - 21')} AS {c}" for c in _RGB) + ", a FROM emb_rgba")
_image("f06_contrast", lambda p: tones.contrast(p, 30.0), "SELECT image_id, w, h, x, y, " + ", ".join(
    f"{_clamp(f'floor((({c} / 255e0 - 0.5e0) * {_num(1.3 ** 2)} + 0.5e0) * 255e0)')} AS {c}" for c in _RGB) + ", a FROM emb_rgba")
_image("f07_hue_rotate", lambda p: tones.hue_rotate(p, 89.6), "SELECT image_id, w, h, x, y, " + ", ".join(
    f"{_clamp('floor(' + ' + '.join(f'{_num(k)} * {v}' for k, v in zip(row, _RGB)) + ')')} AS {c}" for c, row in zip(_RGB, tones.hue_matrix(90))) + ", a FROM emb_rgba")
_image("f10_median", lambda p: tones.median(p, 2),
       "SELECT p.image_id, p.w, p.h, p.x, p.y, " + ", ".join(f"list_sort(list(q.{c}))[13] AS {c}" for c in _RGBA) + " FROM emb_rgba p CROSS JOIN range(-2, 3) u(i) CROSS JOIN range(-2, 3) v(j) "
       "JOIN emb_rgba q ON q.image_id = p.image_id AND q.x = least(greatest(p.x + i, 0), p.w - 1) AND q.y = least(greatest(p.y + j, 0), p.h - 1) GROUP BY ALL")


def _dot_sql(row, names) -> str:
    return "(" + " + ".join(f"{_num(k)} * {n}" for k, n in zip(row, names)) + ")"


_LINEAR = ", ".join(f"CASE WHEN {c} / 255e0 <= 0.04045e0 THEN {c} / 255e0 / 12.92e0 ELSE pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END AS l{c}" for c in _RGB)


def _lab_sql(source: str) -> str:
    """``source`` (r, g, b and more columns) with its OKLab columns ok_l, ok_a, ok_b."""
    cones = ", ".join(f"cbrt({_dot_sql(row, ['lr', 'lg', 'lb'])}) AS c{i}" for i, row in enumerate(tones.TO_LMS))
    lab = ", ".join(f"{_dot_sql(row, ['c0', 'c1', 'c2'])} AS ok_{n}" for n, row in zip("lab", tones.TO_LAB))
    return f"(SELECT *, {lab} FROM (SELECT *, {cones} FROM (SELECT *, {_LINEAR} FROM {source})))"


_LAB = ["ok_l", "ok_a", "ok_b"]
_image("e01_linear", lambda p: p.select("image_id", "x", "y", *[F.round(tones.linear(F.col(c)), 9).alias(c) for c in _RGB]),
       "SELECT image_id, x, y, round(lr, 9) AS r, round(lg, 9) AS g, round(lb, 9) AS b FROM (SELECT image_id, x, y, " + _LINEAR + " FROM emb_rgba)")
_image("e02_oklab", lambda p: _rounded(tones.with_oklab(p), *_LAB).select("image_id", "x", "y", *_LAB),
       "SELECT image_id, x, y, " + ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in _LAB) + f" FROM {_lab_sql('emb_rgba')}")
_BACK = [_dot_sql(row, ["k0 * k0 * k0", "k1 * k1 * k1", "k2 * k2 * k2"]) for row in tones.FROM_LMS]
_CONES = ", ".join(f"{_dot_sql(row, ['ok_l', 'ok_a', 'ok_b'])} AS k{i}" for i, row in enumerate(tones.FROM_LAB))
_SHIFTED = "(SELECT * REPLACE (ok_a * 1.5e0 AS ok_a, ok_b * 1.5e0 AS ok_b) FROM {0})"


def _shifted(p):
    return tones.with_oklab(p).withColumns({"ok_a": F.col("ok_a") * 1.5, "ok_b": F.col("ok_b") * 1.5})


def _linear_back(p):
    rgb = tones.linear_from_oklab(*[F.col(c) for c in _LAB])
    return _shifted(p).select("image_id", "x", "y", *[(F.round(v, 6) + F.lit(0.0)).alias(c) for c, v in zip(_RGB, rgb)])


_image("e04_oklab_to_linear", _linear_back, "SELECT image_id, x, y, " + ", ".join(f"round({v}, 6) + 0e0 AS {c}" for c, v in zip(_RGB, _BACK)) + f" FROM (SELECT *, {_CONES} FROM {_SHIFTED.format(_lab_sql('emb_rgba'))})")
_ENCODE = "CAST(least(greatest(floor(least(greatest(floor(CASE WHEN {0} <= 0.0031308e0 THEN {0} * 12.92e0 ELSE 1.055e0 * pow(greatest({0}, 0e0), " + _num(1 / 2.4) + ") - 0.055e0 END * 255 + 0.5e0), -9e9), 9e9)), 0), 255) AS BIGINT)"
_image("e05_oklab_to_srgb", lambda p: tones.from_oklab(_shifted(p)).select("image_id", "x", "y", *_RGBA),
       "SELECT image_id, x, y, " + ", ".join(f"{_ENCODE.format(f'v{c}')} AS {c}" for c in _RGB) + ", CAST(255 AS BIGINT) AS a FROM (SELECT image_id, x, y, " + ", ".join(f"{v} AS v{c}" for c, v in zip(_RGB, _BACK))
       + f" FROM (SELECT *, {_CONES} FROM {_SHIFTED.format(_lab_sql('emb_rgba'))}))")
_image("e06_round_trip", lambda p: tones.from_oklab(tones.with_oklab(p)).select("image_id", "x", "y", *_RGBA), "SELECT image_id, x, y, r, g, b, CAST(255 AS BIGINT) AS a FROM emb_rgba")
_XYB = ["xyb_x", "xyb_y", "xyb_b"]
_CUBE = [f"(cbrt({_dot_sql(row, ['lr', 'lg', 'lb'])} + {_num(tones.XYB_BIAS)}) - {_num(tones.XYB_BIAS ** (1 / 3))})" for row in tones.XYB]
_image("e08_xyb", lambda p: _rounded(tones.with_xyb(p), *_XYB).select("image_id", "x", "y", *_XYB),
       f"SELECT image_id, x, y, round((l - m) / 2 * 14 + 0.42e0, 6) + 0e0 AS xyb_x, round((l + m) / 2 + 0.01e0, 6) + 0e0 AS xyb_y, round(s - (l + m) / 2 + 0.55e0, 6) + 0e0 AS xyb_b FROM "
       f"(SELECT *, {_CUBE[0]} AS l, {_CUBE[1]} AS m, {_CUBE[2]} AS s FROM (SELECT *, {_LINEAR} FROM emb_rgba))")

# ---- compositing and generated pictures -----------------------------------------------------------------------------------------


def _blend_sql(s: str, d: str, opacity: float) -> str:
    sa, da = f"({s}a / 255e0 * {_num(opacity)})", f"({d}a / 255e0)"
    out = f"({sa} + {da} * (1 - {sa}))"
    byte = lambda v: _clamp(f"floor({v} + 0.5e0 + 1e-6)")
    mix = {c: f"({s}{c} * {sa} + {d}{c} * {da} * (1 - {sa})) / {out}" for c in _RGB} | {"a": f"{out} * 255"}
    return ", ".join(f"CASE WHEN {s}a IS NULL OR {sa} <= 0 THEN {d}{c} ELSE {byte(v)} END AS {c}" for c, v in mix.items())


QUERIES["d01_anchor"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select(
    "doc_id", *[c.alias(f"{p}_{a}") for p in geometry.ANCHORS for a, c in zip("xy", geometry.anchor(p, 5, F.col("n_chars"), F.col("doc_id"), F.lit(301).cast("long"), F.lit(40).cast("long")))])
SQL["d01_anchor"] = "SELECT doc_id, " + ", ".join(
    f"{v} AS {p}_{a}" for p, ij in geometry.ANCHORS.items() for a, k, c, o in zip("xy", ij, ("n_chars", "doc_id"), (301, 40))
    for v in [("CAST(5 AS BIGINT)", _long(f"trunc(({c} - {o}) / 2e0)"), f"{c} - {o} - 5")[k]]) + " FROM documents"
_image("d02_composite", lambda p: geometry.composite_over(p, pixels.invert(geometry.crop(p, 1, 1, 6, 9)), "bottom_right", 3, 0.6),
       f", o AS (SELECT image_id, x - 1 + (w - (least(w, 7) - 1) - 3) AS x, y - 1 + (h - (least(h, 10) - 1) - 3) AS y, 255 - r AS r, 255 - g AS g, 255 - b AS b, a FROM emb_rgba WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 9) "
       f"SELECT p.image_id, p.w, p.h, p.x, p.y, {_blend_sql('o.', 'p.', 0.6)} FROM emb_rgba p LEFT JOIN o USING (image_id, x, y)")
_image("d03_blend_colour", lambda p: p.withColumns({f"s{c}": F.lit(v) for c, v in zip(_RGBA, (200, 30, 90, 128))}).withColumns(geometry.blend_over(0.5)).select(geometry.OUT),
       f"SELECT image_id, w, h, x, y, {_blend_sql('s', 'd', 0.5)} FROM (SELECT *, r AS dr, g AS dg, b AS db, a AS da, 200 AS sr, 30 AS sg, 90 AS sb, 128 AS sa FROM emb_rgba)")


def _watermark(spark, sf_dir):
    p = emb_rgba(spark, sf_dir)
    return geometry.watermark(p, p.where("image_id = 3"), 0.5, "top_center", 1, 0.8)


QUERIES["d04_watermark"] = _watermark
_LOGO_H = "CAST(greatest(round(4e0 * round(w * 0.5e0) / 16e0), 1) AS BIGINT)"
SQL["d04_watermark"] = (
    f"WITH {EMB_RGBA_SQL}, z AS (SELECT w AS cw, h AS ch, CAST(round(w * 0.5e0) AS BIGINT) AS tw, {_LOGO_H} AS th FROM emb_rgba GROUP BY ALL), "
    f"l AS MATERIALIZED (SELECT z.cw * 1000 + z.ch AS image_id, e.w, e.h, e.x, e.y, e.r, e.g, e.b, e.a FROM z, emb_rgba e WHERE e.image_id = 3), "
    f"q AS MATERIALIZED (SELECT * FROM {_resample_sql('l', '(image_id // 1000) // 2', 'CAST(greatest(round(4e0 * ((image_id // 1000) // 2) / 16e0), 1) AS BIGINT)', *_KERNEL_SQL['lanczos3'])}), "
    f"o AS (SELECT image_id // 1000 AS w, image_id % 1000 AS h, x + CAST(trunc((image_id // 1000 - w) / 2e0) AS BIGINT) AS x, y + 1 AS y, {_CH} FROM q) "
    f"SELECT p.image_id, p.w, p.h, p.x, p.y, {_blend_sql('o.', 'p.', 0.8)} FROM emb_rgba p LEFT JOIN o USING (w, h, x, y)")
_SIZED = "(SELECT image_id, w, h, x, unnest(range(h)) AS y FROM (SELECT vec_id AS image_id, w, h, unnest(range(w)) AS x FROM (SELECT vec_id, vec_id % 23 + 1 AS w, vec_id % 17 + 1 AS h FROM embeddings)))"
_BACKDROP, _FRONT = (20, 50, 200, 255), (220, 180, 40, 255)


def _mock(name: str, style: str, columns: str, **more) -> None:
    QUERIES[name] = lambda spark, sf_dir: pixels.mock(
        spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id as image_id", "vec_id % 23 + 1 as w", "vec_id % 17 + 1 as h"), style, _BACKDROP, _FRONT, **more)
    SQL[name] = f"SELECT image_id, w, h, x, y, {columns} FROM (SELECT *, 20 AS dr, 50 AS dg, 200 AS db, 255 AS da, CASE WHEN (x + y) % 10 = 0 THEN 255 END AS sa, 220 AS sr, 180 AS sg, 40 AS sb FROM {_SIZED})"


_FLAT = ", ".join(f"CAST({v} AS BIGINT) AS {c}" for v, c in zip(_BACKDROP, _RGBA))
_mock("d08_mock_solid", "solid", _FLAT)
_mock("d09_mock_stripes", "stripes", _blend_sql("s", "d", 0.07))
_mock("d10_mock_gradient", "gradient", ", ".join(f"CAST(round({v} + (round({v} * {_num(1 - 0.08)}) - {v}) * (y / greatest(h - 1, 1))) AS BIGINT) AS {c}" for v, c in zip(_BACKDROP, _RGB)) + ", CAST(255 AS BIGINT) AS a")
_mock("d11_mock_checker", "checker", ", ".join(f"CAST(CASE WHEN (x // 4 + y // 4) % 2 = 1 THEN round({v} * {_num(1 - 0.04)}) ELSE {v} END AS BIGINT) AS {c}" for v, c in zip(_BACKDROP, _RGB)) + ", CAST(255 AS BIGINT) AS a", tile=3)


def _docs(name: str, make, sql: str, table: str = "documents") -> None:
    QUERIES[name] = lambda spark, sf_dir: make(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    SQL[name] = sql


# Colours are written from ids: every form and some that are none.
_COLOUR_TEXT = "CASE doc_id % 8 WHEN 0 THEN '#' || substr(h, 1, 3) WHEN 1 THEN ' #' || upper(substr(h, 1, 4)) WHEN 2 THEN '#' || substr(h, 1, 6) WHEN 3 THEN '#' || h WHEN 4 THEN 'Black' WHEN 5 THEN 'none' WHEN 6 THEN 'white' ELSE '#' || substr(h, 1, 5) END"


def _colours(d):
    text = d.selectExpr("doc_id", "lower(lpad(hex(doc_id * 2654435 % 4294967296), 8, '0')) as h").selectExpr("doc_id", f"{_COLOUR_TEXT} as text")
    return text.select("doc_id", "text", pixels.parse_colour(F.col("text")).alias("c")).select("doc_id", "text", "c.*")


_CHANNEL = ("CASE WHEN t = 'none' THEN 0 WHEN t = 'black' THEN {1} WHEN t = 'white' THEN 255 WHEN length(t) IN (4, 5) AND {0} < length(t) - 1 THEN CAST('0x' || t[{0} + 2] || t[{0} + 2] AS BIGINT) "
            "WHEN length(t) IN (7, 9) AND 2 * {0} < length(t) - 1 THEN CAST('0x' || t[2 * {0} + 2:2 * {0} + 3] AS BIGINT) WHEN length(t) IN (4, 7) THEN 255 END")
_docs("d13_parse_colour", _colours, "SELECT doc_id, text, " + ", ".join(f"{_CHANNEL.format(k, 255 if k == 3 else 0)} AS {c}" for k, c in enumerate(_RGBA)) +
      f" FROM (SELECT doc_id, text, lower(trim(text)) AS t FROM (SELECT doc_id, {_COLOUR_TEXT} AS text FROM (SELECT doc_id, lower(lpad(printf('%X', doc_id * 2654435 % 4294967296), 8, '0')) AS h FROM documents)))")
_image("d14_darken_lerp", lambda p: p.select("image_id", "x", "y", pixels.darken(F.col("r"), 0.3).alias("dark"), pixels.lerp(F.col("r"), F.col("g"), F.lit(0.25)).alias("between")),
       f"SELECT image_id, x, y, CAST(round(r * {_num(1 - 0.3)}) AS BIGINT) AS dark, CAST(round(r + (g - r) * 0.25e0) AS BIGINT) AS between FROM emb_rgba")

# ---- palettes -------------------------------------------------------------------------------------------------------------------

PALETTE = [(0, 0, 0, 255), (255, 255, 255, 255), (255, 0, 0, 255), (0, 255, 0, 60), (0, 0, 255, 255), (128, 128, 128, 130), (200, 120, 40, 255), (40, 160, 200, 255), (1, 2, 3, 255)]
_ENTRIES = _lab_sql("(VALUES " + ", ".join(f"({i}, {r}, {g}, {b}, {a})" for i, (r, g, b, a) in enumerate(PALETTE)) + ") t(i, r, g, b, a)")


def _assigned_sql(alpha: bool) -> str:
    more = f" + (p.a - q.a) * {_num(tones.ALPHA_SCALE)} * (p.a - q.a) * {_num(tones.ALPHA_SCALE)}" if alpha else ""
    return (f"(SELECT image_id, x, y, min_by(i, struct_pack(d := d, i := i)) AS idx FROM (SELECT p.image_id, p.x, p.y, q.i, (p.ok_l - q.ok_l) * (p.ok_l - q.ok_l) + (p.ok_a - q.ok_a) * (p.ok_a - q.ok_a) "
            f"+ (p.ok_b - q.ok_b) * (p.ok_b - q.ok_b){more} AS d FROM {_lab_sql('emb_rgba')} p CROSS JOIN {_ENTRIES} q) GROUP BY image_id, x, y)")


_image("q08_palette_assign", lambda p: tones.assign_palette(p, PALETTE).select("image_id", "x", "y", "idx"), f"SELECT * FROM {_assigned_sql(True)}")
_image("q09_palette_assign_rgb", lambda p: tones.assign_palette(p, PALETTE, alpha=False).select("image_id", "x", "y", "idx"), f"SELECT * FROM {_assigned_sql(False)}")
_image("k13_palette_used", lambda p: tones.assign_palette(p, PALETTE).groupBy("image_id").agg(F.count_distinct("idx").alias("used")), f"SELECT image_id, count(DISTINCT idx) AS used FROM {_assigned_sql(True)} GROUP BY image_id")
_STEP = f"(SELECT * FROM {_lab_sql('emb_rgba')} JOIN {_assigned_sql(True)} USING (image_id, x, y))"
_image("q04_lloyd_step", lambda p: _rounded(tones.lloyd_step(p, PALETTE), *_LAB, "alpha").drop("sse"),
       f"SELECT image_id, idx, " + ", ".join(f"round(avg({c}), 6) + 0e0 AS {c}" for c in _LAB) + f", round(avg(a), 6) + 0e0 AS alpha, count(*) AS n FROM {_STEP} GROUP BY image_id, idx")
_SQUARES = " + ".join(f"sum({v} * {v}) - sum({v}) * sum({v}) / count(*)" for v in [*_LAB, f"(a * {_num(tones.ALPHA_SCALE)})"])
_image("q06_cluster_sse", lambda p: _rounded(tones.lloyd_step(p, PALETTE), "sse").select("image_id", "idx", "n", "sse"), f"SELECT image_id, idx, count(*) AS n, round(greatest({_SQUARES}, 0e0), 6) + 0e0 AS sse FROM {_STEP} GROUP BY image_id, idx")
_image("q07_importance", lambda p: _rounded(tones.importance(p, 0.5), "weight").select("image_id", "x", "y", "weight"),
       "SELECT p.image_id, p.x, p.y, round(1 / (1 + 0.5e0 * coalesce(avg(abs((p.r + p.g + p.b) // 3 - (q.r + q.g + q.b) // 3)), 0e0)), 6) + 0e0 AS weight FROM emb_rgba p LEFT JOIN emb_rgba q ON q.image_id = p.image_id "
       "AND ((q.y = p.y AND q.x - p.x IN (1, 2)) OR (q.x = p.x AND q.y - p.y IN (1, 2))) GROUP BY ALL")
_COMPACT = f"(SELECT image_id, idx, row_number() OVER (PARTITION BY image_id ORDER BY idx) - 1 AS new_idx, r, g, b, a FROM (SELECT DISTINCT image_id, idx FROM {_assigned_sql(True)}) JOIN {_ENTRIES} e ON e.i = idx)"


def _compact(p):
    return tones.compact(tones.assign_palette(p, PALETTE), PALETTE)


_image("q12_compact_palette", _compact, f"SELECT image_id, idx, CAST(new_idx AS INTEGER) AS new_idx, " + ", ".join(_long(c) + f" AS {c}" for c in _RGBA) + f" FROM {_COMPACT}")
_SORTED = f"(SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (r + g + b) // 3, new_idx) - 1 AS place FROM {_COMPACT})"
_image("q13_luma_sort", lambda p: tones.luma_sorted(_compact(p)).select("image_id", "idx", "place"), f"SELECT image_id, idx, CAST(place AS INTEGER) AS place FROM {_SORTED}")
_image("q14_transparency", lambda p: tones.transparency(tones.luma_sorted(_compact(p)), "place"),
       f"SELECT image_id, CAST(k AS BIGINT) AS stored, array_to_string(l[1:k], ',') AS alphas FROM (SELECT image_id, list(a ORDER BY place) AS l, coalesce(max(CASE WHEN a < 255 THEN place + 1 END), 0) AS k FROM {_SORTED} GROUP BY image_id)")
_docs("q02_sized_palette", lambda d: d.select("doc_id", F.array_join(tones.sized_palette(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 9).cast("int")), lambda i: i * i + 1), 5), ",").alias("entries")),
      "SELECT doc_id, array_to_string([CASE WHEN i <= doc_id % 9 THEN i * i + 1 ELSE 1 END for i in range(5)], ',') AS entries FROM documents")

# ---- content and routing --------------------------------------------------------------------------------------------------------

_image("k01_content_figures", lambda p: _rounded(content.content_figures(p), "opaque", "zero_alpha", "mean_step", "var_step", "mean_step_up", "var_step_up", "run_length"),
       "SELECT image_id, count(*) AS n, round(avg(CASE WHEN a = 255 THEN 1 ELSE 0 END), 6) + 0e0 AS opaque, round(avg(CASE WHEN a = 0 THEN 1 ELSE 0 END), 6) + 0e0 AS zero_alpha, "
       + ", ".join(f"round(avg(abs(luma - l)), 6) + 0e0 AS mean_step{k}, round(var_pop(abs(luma - l)), 6) + 0e0 AS var_step{k}" for k in ("", "_up"))
       + ", round(count(*) / (1 + count_if(r <> pr OR g <> pg OR b <> pb)), 6) + 0e0 AS run_length, count(DISTINCT CASE WHEN a = 255 THEN r + 256 * g + 65536 * b END) AS colours "
       "FROM (SELECT *, lag(luma) OVER (PARTITION BY image_id, y ORDER BY x) AS l, lag(r) OVER s AS pr, "
       "lag(g) OVER s AS pg, lag(b) OVER s AS pb FROM (SELECT *, (r + g + b) // 3 AS luma FROM emb_rgba) WINDOW s AS (PARTITION BY image_id ORDER BY y, x)) GROUP BY image_id")
_image("k03_distinct_colours", pixels.distinct_colours,
       "SELECT image_id, count(*) AS colours, max(n) AS most FROM (SELECT image_id, r, g, b, count(*) AS n FROM emb_rgba WHERE a = 255 GROUP BY ALL) GROUP BY image_id")
_image("k11_unique_ratio", content.unique_colour_ratio, "SELECT image_id, count(DISTINCT (r, g, b)) / count(*) AS ratio FROM emb_rgba GROUP BY image_id")

# Figures of images far larger than the tables hold, spread by id over all branches.
_FIGURES = {
    "w": "1 + doc_id * 7 % 4000", "n": "1 + doc_id * 7919 % 9000000", "opaque": "(doc_id * 13 % 101) / 100e0", "zero_alpha": "(100 - doc_id * 13 % 101) * (doc_id % 5) / 500e0", "mean_step": "(doc_id * 31 % 97) / 10e0",
    "var_step": "(doc_id * 17 % 401) / 1e0", "mean_step_up": "(doc_id * 31 % 89) / 10e0", "var_step_up": "(doc_id * 17 % 211) / 1e0", "run_length": "(doc_id * 11 % 450) / 10e0", "colours": "doc_id * 104729 % 140000",
}
_FIG_SQL = "(SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _FIGURES.items()) + " FROM documents)"
_SIZE_SQL = ("CASE WHEN opaque < 0.95 THEN CASE WHEN mean_step > 5 THEN 256 WHEN colours < 5000 THEN 32 WHEN colours < 25000 THEN 48 ELSE 64 END WHEN mean_step < 1.5 AND var_step < 20 AND colours > 75000 THEN 256 "
             "WHEN mean_step < 5 AND var_step < 150 AND colours > 75000 THEN 256 WHEN colours > 100000 THEN CASE WHEN var_step > 200 THEN 192 ELSE 208 END ELSE 208 END")
_GRADIENT_SQL = "(n >= 200000 AND w >= 2 AND opaque >= 0.95 AND mean_step_up < 1 AND colours >= 1000)"


def _figures(name: str, columns, sql: str) -> None:
    def plain(v: str) -> str:
        return v.replace("100e0", "100D").replace("500e0", "500D").replace("10e0", "10D").replace("1e0", "1D")

    _docs(name, lambda d: d.selectExpr("doc_id", *[f"{plain(v)} as {k}" for k, v in _FIGURES.items()]).select("doc_id", *columns()), f"SELECT doc_id, {sql} FROM {_FIG_SQL}")


_figures("k06_gradient", lambda: [content.is_gradient().alias("gradient")], f"{_GRADIENT_SQL} AS gradient")
_figures("k07_palette_size", lambda: [content.palette_size().alias("n_colours")], f"CAST({_SIZE_SQL} AS INTEGER) AS n_colours")
_figures("k08_importance", lambda: [content.palette_and_importance()["n"].alias("n_colours"), content.palette_and_importance()["alpha"].alias("strength")],
         f"CASE WHEN s = 192 AND var_step > 200 THEN 144 ELSE s END AS n_colours, CASE WHEN s = 192 AND var_step > 200 THEN 0.5e0 ELSE 0e0 END AS strength FROM (SELECT *, {_SIZE_SQL} AS s FROM {_FIG_SQL}) --")
_figures("k09_auto_dither", lambda: [content.auto_dither().alias("dither")], "0e0 AS dither")
_figures("k10_tiered_dither", lambda: [content.tiered_dither().alias("dither")],
         "CASE WHEN n < 200000 THEN 0e0 WHEN opaque < 0.95 THEN CASE WHEN 1 - opaque - zero_alpha >= 0.1e0 THEN CASE WHEN opaque < 0.5 THEN 0.7e0 ELSE 0.35e0 END WHEN colours > 60000 THEN 0.85e0 WHEN colours > 20000 THEN 0.7e0 ELSE 0.5e0 END "
         "WHEN run_length > 2 AND colours < 1000 THEN 0.25e0 WHEN w < 2 THEN 0.5e0 WHEN mean_step_up < 1 THEN 0.7e0 WHEN var_step_up > 50 THEN CASE WHEN run_length > 2 THEN 0.25e0 WHEN mean_step_up > 5 AND mean_step_up <= 7.5 THEN 0.5e0 ELSE 0.7e0 END "
         "WHEN colours > 120000 THEN 0.7e0 ELSE 0.5e0 END AS dither")
_figures("k12_first_dither", lambda: [content.first_dither().alias("dither")], "CASE WHEN opaque >= 0.95 AND n >= 200000 THEN 0.5e0 ELSE 0e0 END AS dither")
_figures("n08_level", lambda: [content.level().alias("level")], "CASE WHEN (n > 500000 AND run_length >= 8) OR run_length >= 32 THEN 'fast' ELSE 'best' END AS level")
def _effort():
    return F.col("doc_id") % 11


_USED = f"CASE WHEN {_GRADIENT_SQL} AND n >= 5000000 AND doc_id % 11 = 5 THEN 1 ELSE doc_id % 11 END"
_figures("z02_png_route", lambda: [content.png_route(_effort())[c].alias(c) for c in ("route", "effort", "preset", "iterations")],
         f"CASE WHEN {_GRADIENT_SQL} THEN 'lossless' ELSE 'palette' END AS route, CAST(u AS INTEGER) AS effort, CAST(CASE WHEN least(u, 10) <> 5 THEN least(u, 6) WHEN n >= 5000000 THEN 1 ELSE 3 END AS INTEGER) AS preset, "
         f"CAST(CASE WHEN u >= 7 THEN least((u - 6) * 5, 30) ELSE 0 END AS INTEGER) AS iterations FROM (SELECT *, {_USED} AS u FROM {_FIG_SQL}) --")
_figures("z11_effort", lambda: [content.encoder_speed(F.col("doc_id") % 14).alias("speed"), content.search_iterations(F.col("doc_id") % 14).alias("iterations")],
         "CAST(greatest(11 - least(doc_id % 14, 10), 1) AS INTEGER) AS speed, CAST(CASE WHEN doc_id % 14 >= 7 THEN least((doc_id % 14 - 6) * 5, 30) ELSE 0 END AS INTEGER) AS iterations")
_figures("z12_preset", lambda: [content.optimiser_preset(_effort(), F.col("n") >= 5_000_000).alias("preset")], "CAST(CASE WHEN doc_id % 11 <> 5 THEN least(doc_id % 11, 6) WHEN n >= 5000000 THEN 1 ELSE 3 END AS INTEGER) AS preset")

# ---- rows, checksums, byte streams ----------------------------------------------------------------------------------------------

_image("sub_filter_cost", lambda p: pixels.sub_filter_cost(p, "r"),
       "SELECT image_id, y, CAST(sum(CASE WHEN v < 128 THEN v ELSE 256 - v END) AS BIGINT) AS cost FROM (SELECT image_id, y, "
       "(r - coalesce(lag(r) OVER (PARTITION BY image_id, y ORDER BY x), 0) + 256) % 256 AS v FROM emb_rgba) GROUP BY ALL")
_RESIDUES = ["v", "v - l", "v - u", "v - (l + u) // 2", "v - CASE WHEN abs(u - c) <= abs(l - c) AND abs(u - c) <= abs(l + u - 2 * c) THEN l WHEN abs(l - c) <= abs(l + u - 2 * c) THEN u ELSE c END"]
_AROUND = ("(SELECT *, coalesce(lag(u) OVER (PARTITION BY image_id, y ORDER BY x), 0) AS c FROM (SELECT image_id, x, y, r AS v, coalesce(lag(r) OVER (PARTITION BY image_id, y ORDER BY x), 0) AS l, "
           "coalesce(lag(r) OVER (PARTITION BY image_id, x ORDER BY y), 0) AS u FROM emb_rgba))")
_FILTERS = ("SELECT image_id, y, CAST(m.f AS INTEGER) AS filter, m.s AS sad FROM (SELECT image_id, y, list_min([" + ", ".join(
    f"{{'s': CAST(sum(least(({e} + 512) % 256, 256 - ({e} + 512) % 256)) AS BIGINT), 'f': {i}}}" for i, e in enumerate(_RESIDUES)) + f"]) AS m FROM {_AROUND} GROUP BY image_id, y)")
_image("n03_row_filters", lambda p: content.row_filters(p, "r"), _FILTERS)
_image("n01_filtered_bytes", lambda p: content.filtered_bytes(p, "r"),
       "SELECT image_id, y, x, filter, (CASE filter " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_RESIDUES)) + f" END + 512) % 256 AS byte FROM {_AROUND} JOIN ({_FILTERS}) USING (image_id, y)")
_image("b14_filter_histogram", lambda p: _rounded(content.filter_histogram(content.row_filters(p, "r")), "percent"),
       f"SELECT image_id, filter, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY image_id), 6) + 0e0 AS percent FROM ({_FILTERS}) GROUP BY image_id, filter")
_image("y03_adler32", lambda p: content.adler32(p.withColumn("i", F.col("y") * F.col("w") + F.col("x")), "image_id", "i", "r"),
       "SELECT image_id, CAST((64 + sum((64 - (y * w + x)) * r)) % 65521 * 65536 + (1 + sum(r)) % 65521 AS BIGINT) AS adler32 FROM emb_rgba GROUP BY image_id")
_image("k05_byte_run_length", lambda p: content.byte_run_length(p.withColumn("i", F.col("y") * F.col("w") + F.col("x")), "image_id", "i", "a"),
       "SELECT image_id, count(*) AS n, count(*) / (1 + count_if(a <> l)) AS run_length FROM (SELECT image_id, a, lag(a) OVER (PARTITION BY image_id ORDER BY y, x) AS l FROM emb_rgba) GROUP BY image_id")
_CRC_STEP = "xor(c >> 1, (c & 1) * 3988292384)"
_CRC_BYTE = "xor(c, v)"
for _ in range(8):
    _CRC_BYTE = f"list_transform([{_CRC_BYTE}], lambda c: {_CRC_STEP})[1]"


def _crc_sql(values: str) -> str:
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {values}), lambda c, v: {_CRC_BYTE}), 4294967295)"


_BYTES = "(SELECT vec_id AS image_id, list_transform(embedding, lambda v: CAST(least(greatest(floor((CAST(v AS DOUBLE) + 1) * 127.5), 0), 255) AS BIGINT)) AS p FROM embeddings)"


def _vector_bytes(spark, sf_dir):
    grey = F.transform("embedding", lambda v: F.least(F.greatest(F.floor((v.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("long"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), grey.alias("p"))


QUERIES["y01_crc32"] = lambda spark, sf_dir: _vector_bytes(spark, sf_dir).select(
    "image_id", F.crc32(F.unhex(F.array_join(F.transform("p", lambda v: F.lpad(F.hex(v), 2, "0")), ""))).alias("crc32"))
SQL["y01_crc32"] = f"SELECT image_id, {_crc_sql('p')} AS crc32 FROM {_BYTES}"
QUERIES["y02_crc32_update"] = lambda spark, sf_dir: _vector_bytes(spark, sf_dir).select("image_id", content.crc32_update(F.lit(0), F.slice("p", 1, 20)).alias("first"), "p").select(
    "image_id", "first", content.crc32_update(F.col("first"), F.slice("p", 21, 44)).alias("crc32"))
SQL["y02_crc32_update"] = f"SELECT image_id, {_crc_sql('p[1:20]')} AS first, {_crc_sql('p')} AS crc32 FROM {_BYTES}"
_docs("y06_stored_size", lambda d: d.select("doc_id", content.stored_size(F.octet_length("text") * (1 + F.col("doc_id") % 9)).alias("stored")),
      "SELECT doc_id, strlen(text) * (1 + doc_id % 9) + 5 * CAST(greatest(ceil(strlen(text) * (1 + doc_id % 9) / 65535), 1) AS BIGINT) AS stored FROM documents")
_docs("y20_match_symbols", lambda d: d.select((F.col("doc_id") % 256 + 3).alias("length"), (F.col("doc_id") * 7919 % 32768 + 1).alias("distance")).distinct().withColumns(content.match_symbols(F.col("length"), F.col("distance"))),
      "WITH s AS (SELECT 257 + i AS sym, CASE WHEN i < 8 THEN 0 ELSE i // 4 - 1 END AS bits, CASE WHEN i < 8 THEN 3 + i ELSE 3 + (4 + i % 4) * (1 << (i // 4 - 1)) END AS low FROM range(28) t(i)), "
      "e AS (SELECT i AS sym, CASE WHEN i < 4 THEN 0 ELSE i // 2 - 1 END AS bits, CASE WHEN i < 4 THEN 1 + i ELSE 1 + (2 + i % 2) * (1 << (i // 2 - 1)) END AS low FROM range(30) t(i)), "
      "d AS (SELECT DISTINCT doc_id % 256 + 3 AS length, doc_id * 7919 % 32768 + 1 AS distance FROM documents) "
      "SELECT length, distance, CASE WHEN length = 258 THEN 285 ELSE s.sym END AS length_symbol, CAST(CASE WHEN length = 258 THEN 0 ELSE s.bits END AS BIGINT) AS length_bits, e.sym AS distance_symbol, CAST(e.bits AS BIGINT) AS distance_bits "
      "FROM d JOIN s ON length BETWEEN s.low AND s.low + (1 << s.bits) - 1 JOIN e ON distance BETWEEN e.low AND e.low + (1 << e.bits) - 1")

# ---- analytics ------------------------------------------------------------------------------------------------------------------

_image("b19_largest_difference", lambda p: pixels.largest_difference(p, pixels.flip_horizontal(p)),
       "SELECT p.image_id, " + ", ".join(f"max(abs(p.{c} - q.{c})) AS max_{c}" for c in _RGB) + ", CAST(sum((p.r - q.r) * (p.r - q.r) + (p.g - q.g) * (p.g - q.g) + (p.b - q.b) * (p.b - q.b)) AS BIGINT) AS sse "
       "FROM emb_rgba p JOIN emb_rgba q ON p.image_id = q.image_id AND p.y = q.y AND p.x = p.w - 1 - q.x GROUP BY p.image_id")
_docs("b07_pareto_frontier", lambda d: analytics.pareto_frontier(d.selectExpr("source", "n_chars div 50 as size", "doc_id div 40 as score"), "source", "size", "score"),
      "WITH d AS (SELECT source, n_chars // 50 AS size, doc_id // 40 AS score FROM documents) SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.source = d.source "
      "AND e.size <= d.size AND e.score >= d.score AND (e.size < d.size OR e.score > d.score))")


def _compared(d):
    sizes = d.groupBy("source", "lang").agg(F.sum("n_chars").alias("bytes"))
    base = sizes.where("lang = 'en' and source <> 'src3'").select(F.col("source").alias("name"), F.col("bytes").alias("baseline_bytes"))
    return analytics.compare_to_baseline(sizes.withColumnRenamed("source", "name"), base)


_BASE_SQL = ("WITH d AS (SELECT source AS name, lang, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY ALL), c AS (SELECT d.name, d.lang, d.bytes, b.bytes AS baseline_bytes, d.bytes / b.bytes AS ratio, "
             "coalesce(d.bytes / b.bytes <= 1.15, true) AS ok FROM d LEFT JOIN d b ON b.name = d.name AND b.lang = 'en' AND b.name <> 'src3') ")
_docs("b03_baseline_compare", lambda d: _rounded(_compared(d), "ratio"), _BASE_SQL + "SELECT * REPLACE (round(ratio, 6) AS ratio) FROM c")
_docs("b04_baseline_totals", lambda d: _rounded(analytics.baseline_totals(_compared(d)), "ratio"),
      _BASE_SQL + "SELECT count(*) AS rows, CAST(sum(bytes) FILTER (baseline_bytes IS NOT NULL) AS BIGINT) AS total_bytes, CAST(sum(baseline_bytes) AS BIGINT) AS total_baseline, count_if(NOT ok) AS failures, "
      "round(sum(bytes) FILTER (baseline_bytes IS NOT NULL) / sum(baseline_bytes), 6) AS ratio, count_if(NOT ok) = 0 AS passed FROM c")
_docs("b18_upper_median", lambda d: _rounded(analytics.upper_median(d, "source", "n_chars", "doc_id"), "rate"),
      "SELECT source, m AS median, round(w / greatest(m, 1), 6) AS rate FROM (SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS m, max(doc_id) AS w FROM documents GROUP BY source)")
_docs("b02_group_averages", lambda d: analytics.group_averages(d, "lang", ["n_chars", "doc_id"], ["fr", "xx", "en", "de"]),
      "SELECT lang, count(*) AS n, CAST(sum(n_chars) // count(n_chars) AS BIGINT) AS avg_n_chars, CAST(sum(doc_id) // count(doc_id) AS BIGINT) AS avg_doc_id, CAST(list_position(['fr', 'xx', 'en', 'de'], lang) AS BIGINT) AS place "
      "FROM documents WHERE lang IN ('fr', 'en', 'de') GROUP BY lang")
_SMALL = "CASE WHEN doc_id % 11 > 0 THEN n_chars - doc_id % 7 END"
_docs("b16_recompression", lambda d: _rounded(analytics.recompression_report(d.withColumn("small", F.expr(_SMALL)), "source", "n_chars", "small"), "ratio", to=9),
      f"SELECT source, CAST(sum(n_chars) FILTER (s IS NOT NULL) AS BIGINT) AS old_bytes, CAST(sum(s) AS BIGINT) AS new_bytes, count_if(s IS NULL) AS errors, round(sum(s) / greatest(sum(n_chars) FILTER (s IS NOT NULL), 1), 9) AS ratio FROM (SELECT *, {_SMALL} AS s FROM documents) GROUP BY source")
_docs("b16_recompression_rows", lambda d: _rounded(analytics.recompression_rows(d.selectExpr("doc_id", "n_chars as old", f"{_SMALL} as new"), "old", "new"), "ratio", to=9),
      f"SELECT doc_id, n_chars AS old, s AS new, round(s / greatest(n_chars, 1), 9) AS ratio FROM (SELECT *, {_SMALL} AS s FROM documents)")
_docs("b09_percentiles", lambda d: _rounded(analytics.percentiles_by_band(d, "l_extendedprice", "l_quantity", [10, 25, 40]), "p50", "p90", "p99", to=4),
      "SELECT CAST(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 WHEN l_quantity < 40 THEN 2 ELSE 3 END AS INTEGER) AS band, count(*) AS n, "
      + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 4) AS p{p}" for p in (50, 90, 99)) + ", max(l_extendedprice) AS largest FROM lineitem GROUP BY ALL", "lineitem")
_docs("b10_distribution", lambda d: _rounded(analytics.distribution(d.selectExpr("n_chars as old", "n_chars - n_chars div 3 as new", "doc_id % 997 / 10D as score"), "old", "new", "score"), "least", "p10", "p50", "p90", "mean", "ratio"),
      "SELECT CAST(sum(o) AS BIGINT) AS old, CAST(sum(n) AS BIGINT) AS new, round(min(s), 6) AS least, " + ", ".join(f"round(quantile_cont(s, {p / 100}), 6) AS p{p}" for p in (10, 50, 90))
      + ", round(avg(s), 6) AS mean, round(sum(n) / sum(o), 6) AS ratio FROM (SELECT n_chars AS o, n_chars - n_chars // 3 AS n, doc_id % 997 / 10e0 AS s FROM documents)")
_docs("b12_sweep", lambda d: analytics.sweep(d.where("lang <> 'en'"), "doc_id", F.col("doc_id") % 50 == 0),
      "SELECT doc_id, CAST(d AS DOUBLE) AS dither, CAST(q.a AS INTEGER) AS q_min, CAST(q.b AS INTEGER) AS q_target FROM documents, (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) u(d), "
      "(VALUES (0, 10), (0, 30), (0, 50), (0, 80), (0, 90), (0, 95), (0, 100), (50, 90), (50, 95), (70, 95), (80, 95), (80, 100)) q(a, b) "
      "WHERE lang <> 'en' AND (doc_id % 50 = 0 OR (d IN (0.5, 1.0) AND a = 0 AND b IN (80, 95, 100)))")
_docs("b15_strategy_ranking", lambda d: analytics.strategy_ranking(d.selectExpr("doc_id div 5 as image", "concat('s', doc_id % 5) as strategy", "n_chars % 97 as best", "n_chars % 89 as fast"), "image", "strategy", "best", "fast"),
      "WITH d AS (SELECT doc_id // 5 AS image, 's' || (doc_id % 5) AS strategy, n_chars % 97 AS best, n_chars % 89 AS fast FROM documents), "
      "b AS (SELECT image, strategy, best FROM d QUALIFY row_number() OVER (PARTITION BY image ORDER BY best, strategy) = 1), f AS (SELECT image, strategy, best FROM d QUALIFY row_number() OVER (PARTITION BY image ORDER BY fast, strategy) = 1) "
      "SELECT b.image, b.strategy AS best_winner, f.strategy AS fast_winner, f.best - b.best AS cost FROM b JOIN f USING (image)")
_docs("s08_baseline_json", lambda d: images.baseline_rows(d.select(F.concat(F.lit('{"fixtures": {"'), F.col("doc_id").cast("string"), F.lit('.png": {"input_bytes": 1, "tinypng_bytes": '), F.col("n_chars").cast("string"), F.lit("}}}")).alias("value"))),
      "SELECT doc_id || '.png' AS name, n_chars AS baseline_bytes FROM documents")

# ---- names ----------------------------------------------------------------------------------------------------------------------



def _pick(*values):
    """One of the values by page_id."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("page_id") % len(values) + 1).cast("int"))


def _ext():
    return _pick("PNG", "jpg", "Tif", "txt")


def _flag():
    return _pick("jpeg", None, "avif")


def _path():
    return F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 7 > 0, F.concat(F.lit("."), _ext())).otherwise(""))


_SHOWN = "['PNG', 'jpg', 'Tif', 'txt'][page_id % 4 + 1]"
_FLAGGED = "['jpeg', NULL, 'avif'][page_id % 3 + 1]"
_KNOWN = "['png', 'jpeg', 'tiff', NULL][page_id % 4 + 1]"
_docs("s09_format", lambda d: d.select("page_id", names.format_of(F.concat("url", F.lit("."), _ext())).alias("format"),
                                       names.shorten_left(F.col("url"), 12).alias("short"), names.derived_name(F.concat("url", F.lit(".png")), "min", "webp").alias("derived")),
      f"SELECT page_id, {_KNOWN} AS format, CASE WHEN length(url) <= 12 THEN url ELSE '…' || right(url, 11) END AS short, url || '.min.webp' AS derived FROM pages", "pages")
_docs("s10_extension", lambda d: d.select("page_id", names.extension_of(_pick("png", "jpeg", "tiff", "auto", "odd")).alias("ext")),
      "SELECT page_id, ['png', 'jpg', 'tiff', '', NULL][page_id % 5 + 1] AS ext FROM pages", "pages")
_docs("s12_compressed_path", lambda d: d.select("page_id", names.compressed_path(_path(), _flag()).alias("beside"), names.compressed_path(_path(), _flag(), F.lit("/out")).alias("inside")),
      "SELECT page_id, '/in/' || page_id || '.min.' || e AS beside, '/out/' || page_id || '.min.' || e AS inside FROM (SELECT page_id, coalesce(['jpg', NULL, 'avif'][page_id % 3 + 1], "
      f"CASE WHEN page_id % 7 > 0 THEN {_SHOWN} END, 'png') AS e FROM pages)", "pages")
_docs("s14_compress_format", lambda d: d.select("page_id", names.compress_format(_flag(), _path()).alias("c")).select("page_id", "c.*"),
      f"SELECT page_id, f AS format, CASE WHEN f IS NULL THEN 'no format' END AS error FROM (SELECT page_id, coalesce({_FLAGGED}, CASE WHEN page_id % 7 > 0 THEN {_KNOWN} END) AS f FROM pages)", "pages")
_docs("z01_encode_route", lambda d: d.select("page_id", names.encode_route(_pick("png", "gif", "auto", "jxl", "webp")).alias("c")).select("page_id", "c.*"),
      "SELECT page_id, ['png', 'passthrough', NULL, NULL, 'webp'][page_id % 5 + 1] AS route, [NULL, NULL, 'invalid', 'unsupported format', NULL][page_id % 5 + 1] AS error FROM pages", "pages")
_docs("z14_dither", lambda d: d.select("page_id", names.parse_dither(_pick("off", "0.25", "x1", "-.5e1")).alias("dither")),
      "SELECT page_id, [0e0, 0.25e0, NULL, -5e0][page_id % 4 + 1] AS dither FROM pages", "pages")
_docs("z15_quality", lambda d: d.select("page_id", names.quality(*[F.when(F.col("page_id") % k == 0, v) for k, v in ((5, F.lit(True)), (4, F.lit("0.01")), (3, F.lit("80")), (2, F.lit("1.5")), (7, F.lit("75")))]).alias("quality")),
      "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'lossless' WHEN page_id % 4 = 0 THEN 'dssim:0.01' WHEN page_id % 3 = 0 THEN 'ssim:80' WHEN page_id % 2 = 0 THEN 'butteraugli:1.5' WHEN page_id % 7 = 0 THEN 'q:75' ELSE 'auto' END AS quality FROM pages", "pages")
_docs("b05_parse_formats", lambda d: d.select("page_id", names.parse_formats(_pick(" png, JPG ,,webp", "gif,odd", " , ", "tiff")).alias("c")).select(
    "page_id", F.array_join("c.formats", ",").alias("formats"), "c.error"),
      "SELECT page_id, ['png,jpeg,webp', NULL, NULL, 'tiff'][page_id % 4 + 1] AS formats, [NULL, 'unknown format: odd', 'no format', NULL][page_id % 4 + 1] AS error FROM pages", "pages")

# ---- ordered dithering, run lengths and error maps -------------------------------------------------------------------------------


def _ordered_matrix(n: int) -> list[list[int]]:
    """The ordered matrix by doubling, as the SQL uses it."""
    if n == 1:
        return [[0]]
    half = _ordered_matrix(n // 2)
    return [[4 * half[y % (n // 2)][x % (n // 2)] + [[0, 2], [3, 1]][y // (n // 2)][x // (n // 2)] for x in range(n)] for y in range(n)]


_NEAR = (f"(SELECT p.image_id, p.x, p.y, list(struct_pack(d := {{d}}, i := q.i) ORDER BY {{d}}, q.i) AS l FROM {_lab_sql('emb_rgba')} p CROSS JOIN {_ENTRIES} q GROUP BY p.image_id, p.x, p.y)").format(
    d=" + ".join(f"(p.ok_{n} - q.ok_{n}) * (p.ok_{n} - q.ok_{n})" for n in "lab") + f" + (p.a - q.a) * {_num(tones.ALPHA_SCALE)} * (p.a - q.a) * {_num(tones.ALPHA_SCALE)}")
_image("q19_ordered_dither", lambda p: tones.ordered_dither(p, PALETTE, 0.05).select("image_id", "x", "y", "idx"),
       f"SELECT image_id, x, y, CASE WHEN l[1].d > 0.05e0 * 0.05e0 AND {_ordered_matrix(8)}[CAST(y % 8 + 1 AS INTEGER)][CAST(x % 8 + 1 AS INTEGER)] / 64e0 < l[1].d / (l[1].d + l[2].d) THEN l[2].i ELSE l[1].i END AS idx FROM {_NEAR}")

_LENGTH = "CASE WHEN i < doc_id % 180 THEN 0 ELSE (i {div} (1 + doc_id % 12)) % 3 END"
_docs("y16_code_length_runs", lambda d: content.code_length_runs(d.selectExpr("doc_id", "explode(sequence(0L, 199 + doc_id % 100)) as i").selectExpr("doc_id", "i", f"{_LENGTH.format(div='div')} as len"), "doc_id", "i", "len"),
      f"WITH c AS (SELECT doc_id, i, {_LENGTH.format(div='//')} AS v FROM (SELECT doc_id, unnest(range(200 + doc_id % 100)) AS i FROM documents)), "
      "r AS (SELECT doc_id, v, min(i) AS start, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, v ORDER BY i) AS g FROM c) GROUP BY doc_id, v, g), "
      "s AS (SELECT doc_id, start, CASE WHEN v = 0 THEN list_transform(range(n // 138), lambda k: [18, 127, 7]) || CASE WHEN n % 138 >= 11 THEN [[18, n % 138 - 11, 7]] WHEN n % 138 >= 3 THEN [[17, n % 138 - 3, 3]] ELSE list_transform(range(n % 138), lambda k: [0, 0, 0]) END "
      "ELSE [[v, 0, 0]] || list_transform(range((n - 1) // 6), lambda k: [16, 3, 2]) || CASE WHEN (n - 1) % 6 >= 3 THEN [[16, (n - 1) % 6 - 3, 2]] ELSE list_transform(range((n - 1) % 6), lambda k: [v, 0, 0]) END END AS l FROM r), "
      "u AS (SELECT doc_id, start, unnest(l) AS e, unnest(range(len(l))) AS place FROM s) "
      "SELECT doc_id, start, CAST(place AS INTEGER) AS place, CAST(e[1] AS INTEGER) AS symbol, CAST(e[2] AS INTEGER) AS extra, CAST(e[3] AS INTEGER) AS bits FROM u")


def _planes(p):
    """Each colour of an image beside its coarser version, as values of 0 to 1."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("plane"), (F.col(c) / 255).alias("v1"), (F.expr(f"{c} div 32 * 32") / 255).alias("v2")) for c in _RGB]))
    return p.select("image_id", "x", "y", each.alias("e")).select("image_id", "x", "y", "e.*")


_PLANES = "(" + " UNION ALL ".join(f"SELECT image_id, x, y, '{c}' AS plane, {c} / 255e0 AS v1, {c} // 32 * 32 / 255e0 AS v2 FROM emb_rgba" for c in _RGB) + ")"
_TAPS = "(VALUES " + ", ".join(f"({k}, {_num(metrics.SMOOTH[abs(k)])})" for k in range(1 - len(metrics.SMOOTH), len(metrics.SMOOTH))) + ")"


def moments_sql(cells: str, key: str = "image_id, plane") -> str:
    """Moments over the full square of weights around each pixel, those outside the image missing."""
    sums = ", ".join(f"sum(dx.f * dy.f * {v}) AS {n}" for n, v in (("mu1", "q.v1"), ("mu2", "q.v2"), ("s11", "q.v1 * q.v1"), ("s22", "q.v2 * q.v2"), ("s12", "q.v1 * q.v2")))
    same = " AND ".join(f"q.{k} = p.{k}" for k in key.split(", "))
    return (f"(SELECT {', '.join('p.' + k for k in key.split(', '))}, p.x, p.y, any_value(p.v1) AS v1, any_value(p.v2) AS v2, {sums} FROM {cells} p JOIN {_TAPS} dx(d, f) ON true JOIN {_TAPS} dy(d, f) ON true "
            f"JOIN {cells} q ON {same} AND q.x = p.x + dx.d AND q.y = p.y + dy.d GROUP BY ALL)")


_MOMENTS = moments_sql("cells")
_CELLS = f", cells AS MATERIALIZED (SELECT * FROM {_PLANES}) "


def _pooled_sql(name: str, error: str) -> str:
    return f"round(avg({error}), 6) + 0e0 AS {name}_mean, round(sqrt(sqrt(avg(power({error}, 4)))), 6) + 0e0 AS {name}_norm4"


_image("m04_plane_products", lambda p: _rounded(metrics.plane_products(_planes(p), [("product", "v1", "v2")]), "product").select("image_id", "plane", "x", "y", "product"),
       f"SELECT image_id, plane, x, y, round(v1 * v2, 6) + 0e0 AS product FROM {_PLANES}")
_image("m06_structural_errors", lambda p: _rounded(metrics.structural_errors(metrics.moments(_planes(p))), "ssim_mean", "ssim_norm4"),
       f"{_CELLS}SELECT image_id, plane, {_pooled_sql('ssim', 'd')} FROM (SELECT image_id, plane, greatest(1 - (1 - (mu1 - mu2) * (mu1 - mu2)) * (2 * (s12 - mu1 * mu2) + {_num(metrics.C2)}) "
       f"/ (s11 - mu1 * mu1 + s22 - mu2 * mu2 + {_num(metrics.C2)}), 0) AS d FROM {_MOMENTS}) GROUP BY image_id, plane")
_image("m07_edge_errors", lambda p: _rounded(metrics.edge_errors(metrics.moments(_planes(p))), "artefact_mean", "artefact_norm4", "lost_mean", "lost_norm4"),
       f"{_CELLS}SELECT image_id, plane, {_pooled_sql('artefact', 'greatest(d, 0)')}, {_pooled_sql('lost', 'greatest(-d, 0)')} FROM "
       f"(SELECT image_id, plane, (1 + abs(v2 - mu2)) / (1 + abs(v1 - mu1)) - 1 AS d FROM {_MOMENTS}) GROUP BY image_id, plane")


def refined_sql(rounds: int, split: bool, first: str | None = None, weight: str = "1e0") -> str:
    """``first`` gives the first palettes, ``weight`` that of a pixel. CTEs p0 (first palettes) to p<rounds>, each with the squared moves of its round."""
    scale, coords = _num(tones.ALPHA_SCALE), ("ok_l", "ok_a", "ok_b")
    out = [f"px AS (SELECT *, a * {scale} AS t, {weight} AS wt FROM {_lab_sql('emb_rgba')})",
           f"p0 AS (SELECT image_id, i AS idx, ok_l, ok_a, ok_b, a AS alpha, true AS live FROM {first or f'(SELECT DISTINCT image_id FROM px) CROSS JOIN {_ENTRIES}'})"]
    dist = " + ".join(f"(x.{c} - q.{c}) * (x.{c} - q.{c})" for c in coords) + f" + (x.t - q.alpha * {scale}) * (x.t - q.alpha * {scale})"
    sse = " + ".join(f"(sum(wt * {p} * {p}) - sum(wt * {p}) * sum(wt * {p}) / sum(wt))" for p in (*coords, "t"))
    for k in range(1, rounds + 1):
        move = " + ".join(f"(s.{c} - p.{c}) * (s.{c} - p.{c})" for c in coords) + f" + (s.alpha - p.alpha) * {scale} * (s.alpha - p.alpha) * {scale}"
        out += [
            f"s{k} AS (SELECT image_id, idx, " + ", ".join(f"sum(wt * {c}) / sum(wt) AS {c}" for c in coords) + f", CAST(round(sum(wt * a) / sum(wt)) AS BIGINT) AS alpha, sum(wt) AS n, {sse} AS sse FROM "
            f"(SELECT x.image_id, x.x, x.y, any_value(x.ok_l) AS ok_l, any_value(x.ok_a) AS ok_a, any_value(x.ok_b) AS ok_b, any_value(x.t) AS t, any_value(x.a) AS a, any_value(x.wt) AS wt, min_by(q.idx, struct_pack(d := {dist}, i := q.idx)) AS idx "
            f"FROM px x JOIN p{k - 1} q ON q.image_id = x.image_id AND q.live GROUP BY x.image_id, x.x, x.y) GROUP BY image_id, idx)",
            f"m{k} AS (SELECT p.image_id, p.idx, p.live, " + ", ".join(f"coalesce(s.{c}, p.{c}) AS {c}" for c in (*coords, "alpha")) + f", n, sse, {move} AS move, "
            f"CASE WHEN NOT p.live THEN 2 WHEN n IS NULL THEN 0 WHEN sse > 0 THEN 1 ELSE 2 END AS kind, greatest(sqrt(sse / n), 0.001e0) / 2 AS half FROM p{k - 1} p LEFT JOIN s{k} s USING (image_id, idx))",
            f"r{k} AS (SELECT *, row_number() OVER (PARTITION BY image_id, kind ORDER BY sse DESC, idx) AS rnk, count(*) FILTER (kind = 0) OVER (PARTITION BY image_id) AS gone, "
            f"count(*) FILTER (kind = 1) OVER (PARTITION BY image_id) AS donors, max(move) OVER (PARTITION BY image_id) AS top, avg(move) OVER (PARTITION BY image_id) AS mean FROM m{k})"]
        live = "r.live AND r.top >= 5e-4 * 5e-4"
        if split:
            out.append(f"p{k} AS (SELECT r.image_id, r.idx, CASE WHEN r.kind = 1 AND r.rnk <= r.gone THEN r.ok_l + r.half ELSE coalesce(d.ok_l - d.half, r.ok_l) END AS ok_l, coalesce(d.ok_a, r.ok_a) AS ok_a, coalesce(d.ok_b, r.ok_b) AS ok_b, "
                       f"coalesce(d.alpha, r.alpha) AS alpha, r.live AND (r.top >= 5e-4 * 5e-4 OR (r.gone > 0 AND r.donors > 0)) AS live FROM r{k} r LEFT JOIN r{k} d ON r.kind = 0 AND d.kind = 1 AND d.image_id = r.image_id AND d.rnk = r.rnk)")
        else:
            out.append(f"p{k} AS (SELECT image_id, idx, ok_l, ok_a, ok_b, alpha, {live} AS live FROM r{k} r)")
    return ", ".join(o.replace(" AS (", " AS MATERIALIZED (", 1) for o in out)


def _refine(p, split: int):
    return tones.refine_palettes(p, tones.palettes_of(p, PALETTE), 2, split)


QUERIES["q05_split_empty"] = lambda spark, sf_dir: _rounded(_refine(emb_rgba(spark, sf_dir), 2).drop("moves"), *_LAB)
SQL["q05_split_empty"] = f"WITH {EMB_RGBA_SQL}, {refined_sql(2, True)} SELECT image_id, idx, " + ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in _LAB) + ", alpha FROM p2"
QUERIES["q17_refine_trace"] = lambda spark, sf_dir: _rounded(tones.refinement_trace(_refine(emb_rgba(spark, sf_dir), 0)), "max_move", "mean_move")
SQL["q17_refine_trace"] = f"WITH {EMB_RGBA_SQL}, {refined_sql(2, False)} " + " UNION ALL ".join(
    f"SELECT image_id, {k} AS round, round(sqrt(any_value(top)), 6) + 0e0 AS max_move, round(sqrt(any_value(mean)), 6) + 0e0 AS mean_move FROM r{k} WHERE live GROUP BY image_id" for k in (1, 2))
