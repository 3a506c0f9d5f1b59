"""Queries of whole chains: trained and refined palettes, likeness over scales, chunk walks, quality search, routes from pictures to settings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, content, filters, geometry, metrics, palettes, pixels, search, tones
from ..sources import chunks, images, sinks
from ..sources.images import EMB_RGBA_SQL, MOSAIC_SQL, emb_rgba
from .registry import QUERIES, SQL, _GRADIENT_SQL, _LAB, _LINEAR, _SIZE_SQL, PALETTE, _image, _lab_sql, _num, _pooled_sql, _rounded, moments_sql, refined_sql

# ---- palettes trained per image --------------------------------------------------------------------------------------------------


def median_cut_sql(k: int, alpha: bool) -> str:
    """CTEs cut_c0 (counted colours) to cut_c<rounds>, and ``trained``: the entries."""
    out = [f"cut_c0 AS (SELECT image_id, r, g, b, {'a' if alpha else '255 AS a'}, count(*) AS n, 0 AS box FROM emb_rgba GROUP BY ALL)"]
    rounds = (k - 1).bit_length()
    for t in range(rounds):
        out += [
            f"cut_u{t} AS (SELECT image_id, box, ch, v, sum(n) AS n FROM (SELECT image_id, box, n, unnest([0, 1, 2, 3]) AS ch, unnest([r, g, b, a]) AS v FROM cut_c{t}) GROUP BY ALL)",
            f"cut_m{t} AS (SELECT image_id, box, ch, max(v) - min(v) AS rng, sum(n) AS total, min(CASE WHEN 2 * upto >= whole THEN v END) AS mid, max(v) AS top, max(CASE WHEN v < most THEN v END) AS below FROM "
            f"(SELECT *, sum(n) OVER (PARTITION BY image_id, box, ch ORDER BY v) AS upto, sum(n) OVER (PARTITION BY image_id, box, ch) AS whole, max(v) OVER (PARTITION BY image_id, box, ch) AS most FROM cut_u{t}) GROUP BY ALL)",
            f"cut_b{t} AS (SELECT * FROM cut_m{t} QUALIFY row_number() OVER (PARTITION BY image_id, box ORDER BY rng DESC, ch) = 1)",
            f"cut_k{t} AS (SELECT *, {k} - count(*) OVER (PARTITION BY image_id) AS room, row_number() OVER (PARTITION BY image_id ORDER BY rng > 0 DESC, total * rng DESC, box) AS rnk FROM cut_b{t})",
            f"cut_c{t + 1} AS (SELECT c.image_id, r, g, b, a, n, 2 * c.box + CASE WHEN ([r, g, b, a])[ch + 1] > CASE WHEN mid = top THEN below ELSE mid END THEN 1 ELSE 0 END AS box "
            f"FROM cut_c{t} c LEFT JOIN (SELECT * FROM cut_k{t} WHERE rng > 0 AND rnk <= room) k ON k.image_id = c.image_id AND k.box = c.box)",
        ]
    mean = ", ".join(f"CAST(floor(sum(n * {c}) / sum(n) + 0.5e0 + 1e-9) AS BIGINT) AS {c}" for c in "rgba")
    out.append(f"trained AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY box) - 1 AS idx, {mean}, CAST(sum(n) AS BIGINT) AS n FROM cut_c{rounds} GROUP BY image_id, box)")
    return ", ".join(o.replace(" AS (", " AS MATERIALIZED (", 1) for o in out)


_image("q01_median_cut", lambda p: palettes.median_cut(p, 8), f", {median_cut_sql(8, True)} SELECT * FROM trained")
_image("q03_median_cut_rgb", lambda p: palettes.median_cut(p, 5, alpha=False), f", {median_cut_sql(5, False)} SELECT * FROM trained")
_SPARE = "(SELECT image_id, idx AS i, ok_l, ok_a, ok_b, a FROM lab UNION ALL SELECT image_id, unnest(range(own, 12)) AS i, ok_l, ok_a, ok_b, a FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS own FROM lab) WHERE idx = 0)"
_FOUND = "SELECT image_id, idx, " + ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in _LAB) + ", alpha FROM p2"
_TRAINED_LAB = f"lab AS MATERIALIZED (SELECT * FROM {_lab_sql('trained')})"
_image("q01_trained_refined", lambda p: _rounded(tones.refine_palettes(p, palettes.trained_palettes(p, 12), 2).drop("moves"), *_LAB),
       f", {median_cut_sql(12, True)}, {_TRAINED_LAB}, {refined_sql(2, False, _SPARE)} {_FOUND}")
_WEIGHTS = ("(SELECT p.image_id, p.x, p.y, 1 / (1 + 0.5e0 * coalesce(avg(abs((p.r + p.g + p.b) // 3 - (q.r + q.g + q.b) // 3)), 0e0)) AS wgt FROM emb_rgba p LEFT JOIN emb_rgba q ON q.image_id = p.image_id "
            "AND ((q.y = p.y AND q.x - p.x IN (1, 2)) OR (q.x = p.x AND q.y - p.y IN (1, 2))) GROUP BY ALL)")
_image("q07_weighted_palettes", lambda p: _rounded(tones.refine_palettes(tones.importance(p, 0.5), tones.palettes_of(p, PALETTE), 2, weight="weight").drop("moves"), *_LAB),
       f", weighed AS MATERIALIZED (SELECT * FROM emb_rgba JOIN {_WEIGHTS} USING (image_id, x, y)), {refined_sql(2, False, weight='wgt').replace('FROM emb_rgba', 'FROM weighed')} {_FOUND}")

# ---- likeness over scales -------------------------------------------------------------------------------------------------------


def _coarse(p):
    """The picture in steps of 32, a quarter brighter in its left half."""
    return p.withColumns({c: F.least(F.expr(f"{c} div 32 * 32 + CASE WHEN 2 * x < w THEN {c} div 4 ELSE 0 END"), F.lit(255)) for c in "rgb"})


_COARSE = ", ".join(f"least({c} // 32 * 32 + CASE WHEN 2 * x < w THEN {c} // 4 ELSE 0 END, 255) AS {c}" for c in "rgb")
_BOTH = [f"{c}{k}" for k in (1, 2) for c in "rgb"]


def _planes(p):
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("plane"), (F.col(c) / 255).alias("v1"), (F.expr(f"{c} div 32 * 32") / 255).alias("v2")) for c in "rgb"]))
    return p.select("image_id", "x", "y", each.alias("e")).select("image_id", "x", "y", "e.*")


_PLANE_SQL = " UNION ALL ".join(f"SELECT image_id, x, y, '{c}' AS plane, {c} / 255e0 AS v1, {c} // 32 * 32 / 255e0 AS v2 FROM emb_rgba" for c in "rgb")
_MOMENT_NAMES = ["mu1", "mu2", "s11", "s22", "s12"]
_image("m05_gaussian_moments", lambda p: _rounded(metrics.moments(_planes(p)), *_MOMENT_NAMES).select("image_id", "plane", "x", "y", *_MOMENT_NAMES),
       f", cells AS MATERIALIZED ({_PLANE_SQL}) SELECT image_id, plane, x, y, " + ", ".join(f"round({m}, 6) + 0e0 AS {m}" for m in _MOMENT_NAMES) + f" FROM {moments_sql('cells')}")


def smoothed_sql(cells: str, key: str) -> list[str]:
    """CTEs to ``smooth``: moments along rows, then along columns, by joins."""
    taps = "(VALUES " + ", ".join(f"({k}, {_num(metrics.SMOOTH[abs(k)])})" for k in range(1 - len(metrics.SMOOTH), len(metrics.SMOOTH))) + ") t(d, f)"
    keys = key.split(", ")
    step = lambda src, at, other: (
        f"(SELECT {', '.join('p.' + k for k in keys)}, p.x, p.y, any_value(p.v1) AS v1, any_value(p.v2) AS v2, " + ", ".join(f"sum(q.f * q.{m}) AS {m}" for m in _MOMENT_NAMES)
        + f" FROM {src} p JOIN (SELECT * REPLACE ({at} - d AS {at}) FROM {src} s CROSS JOIN {taps}) q ON {' AND '.join(f'q.{k} = p.{k}' for k in keys)} AND q.{at} = p.{at} AND q.{other} = p.{other} GROUP BY ALL)")
    raw = f"(SELECT *, v1 AS mu1, v2 AS mu2, v1 * v1 AS s11, v2 * v2 AS s22, v1 * v2 AS s12 FROM {cells})"
    return [f"raw_cells AS {raw}", f"across AS {step('raw_cells', 'x', 'y')}", f"smooth AS {step('across', 'y', 'x')}"]


def likeness_sql(scales: int = metrics.SCALES, least: int = metrics.LEAST_SIDE) -> str:
    """CTEs from ``mosaic`` to ``errors``, scale by scale."""
    side = lambda src, k: f"(SELECT image_id, w, h, x, y, lr AS r{k}, lg AS g{k}, lb AS b{k} FROM (SELECT *, {_LINEAR} FROM {src}))"
    out = [f"s0 AS (SELECT * FROM {side('mosaic', 1)} JOIN {side(f'(SELECT image_id, w, h, x, y, {_COARSE} FROM mosaic)', 2)} USING (image_id, w, h, x, y) WHERE w >= {least} AND h >= {least})"]
    for k in range(1, scales):
        # Each output pixel reads its four, those beyond the edge being the last.
        means = ", ".join(f"avg(p.{c}) AS {c}" for c in _BOTH)
        out.append(f"s{k} AS (SELECT o.image_id, o.w, o.h, o.x, o.y, {means} FROM (SELECT *, unnest([0, 1, 0, 1]) AS i, unnest([0, 0, 1, 1]) AS j FROM (SELECT image_id, (w + 1) // 2 AS w, (h + 1) // 2 AS h, x // 2 AS x, y // 2 AS y, w AS pw, h AS ph "
                   f"FROM s{k - 1} WHERE x % 2 = 0 AND y % 2 = 0 AND w >= {least} AND h >= {least})) o JOIN s{k - 1} p ON p.image_id = o.image_id AND p.x = least(2 * o.x + o.i, o.pw - 1) AND p.y = least(2 * o.y + o.j, o.ph - 1) GROUP BY ALL)")
    dot = lambda row, k: "(" + " + ".join(f"{_num(w)} * {c}{k}" for w, c in zip(row, "rgb")) + ")"
    cone = lambda i, k: f"(cbrt({dot(tones.XYB[i], k)} + {_num(tones.XYB_BIAS)}) - {_num(tones.XYB_BIAS ** (1 / 3))})"
    plane = lambda k: [f"({cone(0, k)} - {cone(1, k)}) / 2 * 14 + 0.42e0", f"({cone(0, k)} + {cone(1, k)}) / 2 + 0.01e0", f"{cone(2, k)} - ({cone(0, k)} + {cone(1, k)}) / 2 + 0.55e0"]
    every = " UNION ALL ".join(f"SELECT *, {k} AS scale FROM s{k}" for k in range(scales))
    out.append(f"cells AS (SELECT image_id, scale, x, y, unnest([0, 1, 2]) AS plane, unnest([{', '.join(plane(1))}]) AS v1, unnest([{', '.join(plane(2))}]) AS v2 FROM ({every}))")
    ssim = (f"greatest(1 - (1 - (mu1 - mu2) * (mu1 - mu2)) * (2 * (s12 - mu1 * mu2) + {_num(metrics.C2)}) / (s11 - mu1 * mu1 + s22 - mu2 * mu2 + {_num(metrics.C2)}), 0e0)")
    edge = "((1 + abs(v2 - mu2)) / (1 + abs(v1 - mu1)) - 1)"
    pooled = ", ".join(_pooled_sql(n, e).replace("round(", "(").replace(", 6) + 0e0", ")") for n, e in (("ssim", ssim), ("artefact", f"greatest({edge}, 0e0)"), ("lost", f"greatest(-{edge}, 0e0)")))
    out += smoothed_sql("cells", "image_id, scale, plane")
    out.append(f"errors AS (SELECT image_id, scale, plane, {pooled} FROM smooth GROUP BY ALL)")
    return ", ".join(o.replace(" AS (", " AS MATERIALIZED (", 1) for o in out)


def _mosaic(name: str, make, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(images.mosaics(spark, sf_dir))
    SQL[name] = f"WITH {MOSAIC_SQL} {sql}"


_FIGURES = ["ssim_mean", "artefact_mean", "lost_mean", "ssim_norm4", "artefact_norm4", "lost_norm4"]
_mosaic("m08_scale_errors", lambda p: _rounded(metrics.scale_errors(metrics.pyramid(metrics.linear_pairs(p, _coarse(p)))), *_FIGURES),
        f", {likeness_sql()} SELECT image_id, scale, plane, " + ", ".join(f"round({f}, 6) + 0e0 AS {f}" for f in _FIGURES) + " FROM errors")
_WEIGHT_SQL = "[" + ", ".join(_num(w) for w in metrics.WEIGHTS) + "]"
_POWERS = f"{_num(metrics.CUBIC[0])} * s + {_num(metrics.CUBIC[1])} * s * s + {_num(metrics.CUBIC[2])} * s * s * s"
_mosaic("m08_likeness", lambda p: _rounded(metrics.likeness(p, _coarse(p)), "score", to=4),
        f", {likeness_sql()}, placed AS (SELECT e.image_id, scales, (plane * scales + scale) * 6 + i AS place, v FROM (SELECT image_id, scale, plane, unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([{', '.join(_FIGURES)}]) AS v FROM errors) e "
        f"JOIN (SELECT image_id, max(scale) + 1 AS scales FROM errors GROUP BY image_id) USING (image_id)), total AS (SELECT image_id, scales, {_num(metrics.SUM_SCALE)} * sum(abs(v) * {_WEIGHT_SQL}[place + 1]) AS s FROM placed GROUP BY ALL) "
        f"SELECT image_id, scales, round(CASE WHEN {_POWERS} > 0 THEN 100 - 10 * power({_POWERS}, {_num(metrics.POWER)}) ELSE 100e0 END, 4) + 0e0 AS score FROM total")

# ---- from pictures to settings --------------------------------------------------------------------------------------------------


def routed(p):
    """Every setting that automatic compression takes from a picture: figures of its pixels, then size and importance of the palette, dithering and route."""
    sizes = p.where("x = 0 and y = 0").select("image_id", "w")
    d = content.content_figures(p).join(sizes, "image_id").withColumn("effort", F.lit(5))
    route, palette = content.png_route(F.col("effort")), content.palette_and_importance()
    return d.select(
        "image_id", "n", F.round("mean_step", 6).alias("mean_step"), F.round("run_length", 6).alias("run_length"), "colours", content.is_gradient().alias("gradient"), content.palette_size().alias("n_colours"),
        palette["n"].alias("n_weighted"), palette["alpha"].alias("strength"), content.tiered_dither().alias("tiered"), content.first_dither().alias("first_dither"), content.auto_dither().alias("dither"), content.level().alias("level"),
        *[route[c].alias(c) for c in ("route", "effort", "preset", "iterations")])


_PICTURE = ("(SELECT image_id, any_value(w) AS w, count(*) AS n, avg(CASE WHEN a = 255 THEN 1e0 ELSE 0e0 END) AS opaque, avg(CASE WHEN a = 0 THEN 1e0 ELSE 0e0 END) AS zero_alpha, "
            "coalesce(avg(abs(luma - l)), 0e0) AS mean_step, coalesce(var_pop(abs(luma - l)), 0e0) AS var_step, coalesce(avg(abs(luma - l)), 0e0) AS mean_step_up, coalesce(var_pop(abs(luma - l)), 0e0) AS var_step_up, "
            "count(*) / (1 + count_if(r <> pr OR g <> pg OR b <> pb)) AS run_length, count(DISTINCT CASE WHEN a = 255 THEN r + 256 * g + 65536 * b END) AS colours "
            "FROM (SELECT *, lag(luma) OVER (PARTITION BY image_id, y ORDER BY x) AS l, lag(r) OVER s AS pr, lag(g) OVER s AS pg, lag(b) OVER s AS pb FROM (SELECT *, (r + g + b) // 3 AS luma FROM mosaic) "
            "WINDOW s AS (PARTITION BY image_id ORDER BY y, x)) GROUP BY image_id)")
# Pictures under half a million pixels: every row is looked at, so both step figures agree.
_TIERED = ("CASE WHEN n < 200000 THEN 0e0 WHEN opaque < 0.95 THEN CASE WHEN 1 - opaque - zero_alpha >= 0.1e0 THEN CASE WHEN opaque < 0.5 THEN 0.7e0 ELSE 0.35e0 END WHEN colours > 60000 THEN 0.85e0 WHEN colours > 20000 THEN 0.7e0 ELSE 0.5e0 END "
           "WHEN run_length > 2 AND colours < 1000 THEN 0.25e0 WHEN w < 2 THEN 0.5e0 WHEN mean_step_up < 1 THEN 0.7e0 WHEN var_step_up > 50 THEN CASE WHEN run_length > 2 THEN 0.25e0 WHEN mean_step_up > 5 AND mean_step_up <= 7.5 THEN 0.5e0 ELSE 0.7e0 END "
           "WHEN colours > 120000 THEN 0.7e0 ELSE 0.5e0 END")
_mosaic("z02_routed_pictures", routed,
        f"SELECT image_id, n, round(mean_step, 6) AS mean_step, round(run_length, 6) AS run_length, colours, {_GRADIENT_SQL} AS gradient, CAST(s AS INTEGER) AS n_colours, CAST(CASE WHEN s = 192 AND var_step > 200 THEN 144 ELSE s END AS INTEGER) AS n_weighted, "
        f"CASE WHEN s = 192 AND var_step > 200 THEN 0.5e0 ELSE 0e0 END AS strength, {_TIERED} AS tiered, CASE WHEN opaque >= 0.95 AND n >= 200000 THEN 0.5e0 ELSE 0e0 END AS first_dither, 0e0 AS dither, "
        f"CASE WHEN (n > 500000 AND run_length >= 8) OR run_length >= 32 THEN 'fast' ELSE 'best' END AS level, CASE WHEN {_GRADIENT_SQL} THEN 'lossless' ELSE 'palette' END AS route, CASE WHEN {_GRADIENT_SQL} AND n >= 5000000 THEN 1 ELSE 5 END AS effort, "
        f"CASE WHEN {_GRADIENT_SQL} AND n >= 5000000 THEN 1 WHEN n >= 5000000 THEN 1 ELSE 3 END AS preset, 0 AS iterations FROM (SELECT *, {_SIZE_SQL} AS s FROM {_PICTURE})")

# ---- chunks of files ------------------------------------------------------------------------------------------------------------

# Files written from texts in both engines: a header, a palette, a transparency table, the text in one to four pieces, an end; some are cut short or start otherwise.


def _let(value, f):
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _files(spark, sf_dir):
    def part(kind: str, body):
        return _let(body, lambda h: F.concat(F.lpad(F.hex((F.length(h) / 2).cast("long")), 8, "0"), F.lit(kind.encode().hex().upper()), h, F.lit("00000000")))

    i = F.col("doc_id")
    pieces = (i % 4 + 1).cast("int")

    def whole(t):
        step = 2 * (F.floor(F.length(t) / 2 / pieces).cast("int") + 1)
        texts = [F.when(pieces > k, part("IDAT", F.substring(t, k * step + 1, step))).otherwise("") for k in range(4)]
        head = F.concat(F.lit("0000001000000010080"), (3 * (i % 2)).cast("string"), F.lit("000000"))
        extra = F.when(i % 3 == 0, part("tRNS", F.substring(t, F.lit(1), (2 * (i % 4)).cast("int")))).otherwise("")
        return F.concat(F.lit(chunks.SIGNATURE), part("IHDR", head), part("PLTE", F.repeat(F.lit("0A0B0C"), (i % 5).cast("int"))), extra, *texts, F.lit("0000000049454E4400000000"))

    def broken(f):
        cut = F.when(i % 7 == 1, 2 * (i % 30)).when(i % 7 == 3, 24).otherwise(0).cast("int")
        return F.concat(F.when(i % 7 == 2, "00").otherwise("89"), F.substring(f, F.lit(3), F.length(f) - 2 - cut))

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(i.alias("file"), F.unhex(_let(_let(F.hex(F.coalesce("text", F.lit(""))), whole), broken)).alias("content"))


def _file_sql() -> str:
    part = lambda kind, body: f"lpad(hex(length({body}) // 2), 8, '0') || '{kind.encode().hex().upper()}' || {body} || '00000000'"
    texts = " || ".join(f"CASE WHEN pieces > {k} THEN {part('IDAT', f'substr(t, {k} * step + 1, step)')} ELSE '' END" for k in range(4))
    head, table = "('0000001000000010080' || CAST(3 * (doc_id % 2) AS VARCHAR) || '000000')", "repeat('0A0B0C', CAST(doc_id % 5 AS INT))"
    whole = (f"'{chunks.SIGNATURE}' || {part('IHDR', head)} || {part('PLTE', table)} || CASE WHEN doc_id % 3 = 0 THEN {part('tRNS', 'substr(t, 1, 2 * (doc_id % 4))')} ELSE '' END || {texts} || '0000000049454E4400000000'")
    broken = "CASE doc_id % 7 WHEN 1 THEN substr(f, 1, length(f) - 2 * (doc_id % 30)) WHEN 2 THEN '00' || substr(f, 3) WHEN 3 THEN substr(f, 1, length(f) - 24) ELSE f END"
    return (f"SELECT doc_id AS file, {broken} AS f FROM (SELECT doc_id, {whole} AS f FROM (SELECT *, 2 * (length(t) // 2 // pieces + 1) AS step FROM "
            "(SELECT doc_id, doc_id % 4 + 1 AS pieces, hex(coalesce(text, '')) AS t FROM documents)))")


_AT = "CAST('0x' || substr(f, pos, 8) AS BIGINT)"
_WALK = (f"WITH RECURSIVE files AS MATERIALIZED ({_file_sql()}), "
         f"walk(file, f, pos, chunk_no, type, start, length, error) AS (SELECT file, f, CAST(17 AS BIGINT), -1, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CASE WHEN substr(f, 1, 16) <> '89504E470D0A1A0A' THEN 'signature' END FROM files "
         f"UNION ALL SELECT file, f, CAST(pos + 24 + 2 * {_AT} AS BIGINT), chunk_no + 1, decode(unhex(substr(f, pos + 8, 8))), (pos - 1) // 2 + 8, {_AT}, CASE WHEN pos - 1 + 24 + 2 * {_AT} > strlen(f) THEN 'overrun' END "
         f"FROM walk WHERE error IS NULL AND coalesce(type, '') <> 'IEND' AND pos - 1 + 24 <= strlen(f)), "
         f"found AS MATERIALIZED (SELECT file, CASE WHEN strlen(f) > 50 THEN CAST('0x' || substr(f, 51, 2) AS BIGINT) END AS colour_type, CASE WHEN chunk_no >= 0 THEN CAST(chunk_no AS BIGINT) END AS chunk_no, type, CAST(start AS BIGINT) AS start, length, error FROM walk WHERE chunk_no >= 0 OR error IS NOT NULL) ")
QUERIES["s18_chunk_walk"] = lambda spark, sf_dir: chunks.walk_chunks(_files(spark, sf_dir))
SQL["s18_chunk_walk"] = f"{_WALK} SELECT * FROM found"
QUERIES["s16_chunk_figures"] = lambda spark, sf_dir: chunks.chunk_figures(chunks.walk_chunks(_files(spark, sf_dir)))
SQL["s16_chunk_figures"] = (
    f"{_WALK} SELECT file, max(colour_type) AS colour_type, CAST(coalesce(min(CASE WHEN type = 'PLTE' THEN length END), 0) // 3 AS BIGINT) AS palette, CAST(coalesce(min(CASE WHEN type = 'tRNS' THEN length END), 0) AS BIGINT) AS transparency, "
    "CAST(coalesce(sum(CASE WHEN type = 'IDAT' THEN length END), 0) AS BIGINT) AS idat, count(chunk_no) AS chunks, min(error) AS error FROM found GROUP BY file")


def _streams(spark, sf_dir):
    files = _files(spark, sf_dir)
    return chunks.stream_of(files, chunks.walk_chunks(files)).select("file", "size", F.sha2("stream", 256).alias("sha256"), "error")


QUERIES["s17_idat_stream"] = _streams
SQL["s17_idat_stream"] = (
    f"{_WALK}, sums AS (SELECT file, CAST(coalesce(sum(CASE WHEN type = 'IDAT' THEN length END), 0) AS BIGINT) AS size, min(error) AS error FROM found GROUP BY file), "
    "joined AS (SELECT file, string_agg(substr(f, CAST(2 * start + 1 AS INT), CAST(2 * length AS INT)), '' ORDER BY chunk_no) AS h FROM found JOIN files USING (file) WHERE type = 'IDAT' GROUP BY file) "
    "SELECT file, size, CASE WHEN error IS NULL THEN sha256(unhex(coalesce(h, ''))) END AS sha256, error FROM sums LEFT JOIN joined USING (file)")

QUERIES["s02_identify"] = lambda spark, sf_dir: images.identify(_files(spark, sf_dir))
SQL["s02_identify"] = (f"SELECT file, CASE WHEN ok THEN 'png' END AS format, CASE WHEN ok THEN CAST('0x' || f[33:40] AS BIGINT) END AS w, CASE WHEN ok THEN CAST('0x' || f[41:48] AS BIGINT) END AS h, CASE WHEN NOT ok THEN 'codec' END AS error "
                       f"FROM (SELECT file, f, f[1:16] = '{chunks.SIGNATURE}' AND length(f) >= 48 AS ok FROM ({_file_sql()}))")

# ---- filters by kind, edges ------------------------------------------------------------------------------------------------------

_KINDS = ["grayscale", "invert", "brightness", "contrast"]


def _filtered(p):
    out = None
    for kind in _KINDS:
        one = filters.apply_filter(p, kind).select(F.lit(kind).alias("kind"), "image_id", "x", "y", "r", "g", "b", "a")
        out = one if out is None else out.unionByName(one)
    return out


_BY_KIND = {"grayscale": "(2126 * r + 7152 * g + 722 * b) // 10000", "invert": "255 - {0}", "brightness": "least({0} + 20, 255)", "contrast": "greatest(least(floor((({0} / 255e0 - 0.5e0) * power(1.2e0, 2) + 0.5e0) * 255), 255), 0)"}
_image("f08_default_filters", _filtered, " UNION ALL ".join(f"SELECT '{k}' AS kind, image_id, x, y, " + ", ".join(f"CAST({v.format(c)} AS BIGINT) AS {c}" for c in "rgb") + ", a FROM emb_rgba" for k, v in _BY_KIND.items()))
_image("f09_denoise", lambda p: filters.denoise(p, "median", 0.5).select("image_id", "x", "y", "r", "a"),
       "SELECT p.image_id, p.x, p.y, CAST(list_sort(list(q.r))[5] AS BIGINT) AS r, CAST(list_sort(list(q.a))[5] AS BIGINT) AS a FROM (SELECT *, unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) AS i, unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) AS j FROM emb_rgba) p "
       "JOIN emb_rgba q ON q.image_id = p.image_id AND q.x = least(greatest(p.x + i, 0), p.w - 1) AND q.y = least(greatest(p.y + j, 0), p.h - 1) GROUP BY ALL")
_image("g14_cropped_away", lambda p: geometry.cropped_away(p, 9, -3, 4, 5), "SELECT image_id, w, h, 'invalid' AS error FROM emb_rgba WHERE x = 0 AND y = 0 AND w <= 9")
QUERIES["g20_rect_edges"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select(
    "doc_id", *[c.alias(n) for n, c in geometry.rect_edges(F.col("doc_id") * 1000 - 5, F.lit(2147483000) - F.col("doc_id"), F.col("n_chars"), F.col("n_chars")).items()])
SQL["g20_rect_edges"] = ("SELECT doc_id, doc_id * 1000 - 5 AS \"left\", 2147483000 - doc_id AS top, least(doc_id * 1000 - 5 + n_chars, 2147483647) AS \"right\", least(2147483000 - doc_id + n_chars, 2147483647) AS bottom FROM documents")

# ---- search, sizes, result lines ------------------------------------------------------------------------------------------------

# Trials: a picture in colour steps that grow as the quality falls; the mean error of its red and the number of colours left.


def _search(spark, sf_dir):
    p = emb_rgba(spark, sf_dir)
    at = p.withColumn("q", F.explode(F.sequence(F.lit(search.LOWEST), F.lit(search.HIGHEST)))).withColumn("s", 101 - F.col("q"))
    trials = at.groupBy(F.col("image_id").alias("id"), "q").agg((F.sum(F.expr("r - r div s * s")) / F.count("*")).alias("score"), F.count_distinct(F.expr("r div s"), F.expr("g div s")).alias("size"))
    rows = p.where("x = 0 and y = 0").select(F.col("image_id").alias("id"), ((F.col("image_id") % 60 - 1) / 2).alias("target"))
    return _rounded(search.quality_search(rows, trials, lower_is_better=True), "score")


QUERIES["z10_quality_search"] = _search
SQL["z10_quality_search"] = (
    f"WITH RECURSIVE {EMB_RGBA_SQL}, trials AS MATERIALIZED (SELECT image_id AS id, q, sum(r - r // s * s) / CAST(count(*) AS DOUBLE) AS score, count(DISTINCT (r // s, g // s)) AS size FROM (SELECT *, 101 - q AS s FROM (SELECT *, unnest(range({search.LOWEST}, {search.HIGHEST + 1})) AS q FROM emb_rgba)) GROUP BY ALL), "
    f"walk(id, target, lo, hi, best, last, tried) AS (SELECT DISTINCT image_id, (image_id % 60 - 1) / 2e0, {search.LOWEST}, {search.HIGHEST}, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 0 FROM emb_rgba "
    "UNION ALL SELECT w.id, target, CASE WHEN score <= target THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN score <= target THEN (lo + hi) // 2 - 1 ELSE hi END, CASE WHEN score <= target THEN q ELSE best END, q, tried + 1 "
    "FROM walk w JOIN trials t ON t.id = w.id AND t.q = (lo + hi) // 2 WHERE lo <= hi) "
    "SELECT w.id, CAST(t.q AS INTEGER) AS q, round(t.score, 6) + 0e0 AS score, t.size, w.best IS NOT NULL AS met, CAST(w.tried AS INTEGER) AS tried FROM walk w JOIN trials t ON t.id = w.id AND t.q = coalesce(w.best, w.last) WHERE w.lo > w.hi")


def _sizes(spark, sf_dir):
    """Sizes of the rows of pictures coded two ways: runs of equal values, and counts of differing neighbours, with a fixed share for the frame of a file."""
    f = pixels_figures(emb_rgba(spark, sf_dir))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(s).alias("stage"), v.alias("size")) for p, s, v in (
        ("A", "total", F.col("runs") * 3 + 57), ("B", "total", F.col("steps") * 2 + 57), ("A", "idat", F.col("runs") * 3), ("B", "idat", F.col("steps") * 2), ("A", "swapped", F.col("runs") * 2 + 57), ("B", "swapped", F.col("steps") * 3 + 57))]))
    return analytics.size_matrix(f.select("image_id", each.alias("e")).select("image_id", "e.*"), "image_id", "path", "stage", "size")


def pixels_figures(p):
    """Distinct values of red, and the sum of its filter costs, per picture."""
    costs = pixels.sub_filter_cost(p, "r").groupBy("image_id").agg(F.sum("cost").alias("steps"))
    return p.groupBy("image_id").agg(F.count_distinct("r").alias("runs")).join(costs, "image_id")


QUERIES["b11_size_matrix"] = _sizes
SQL["b11_size_matrix"] = (
    f"WITH {EMB_RGBA_SQL}, f AS (SELECT image_id, count(DISTINCT r) AS runs, CAST(sum(CASE WHEN v < 128 THEN v ELSE 256 - v END) AS BIGINT) AS steps FROM (SELECT image_id, r, (r - coalesce(lag(r) OVER (PARTITION BY image_id, y ORDER BY x), 0) + 256) % 256 AS v FROM emb_rgba) GROUP BY image_id) "
    "SELECT image_id, runs * 3 + 57 AS a_total, steps * 2 + 57 AS b_total, runs * 3 AS a_idat, steps * 2 AS b_idat, runs * 2 + 57 AS a_swapped, steps * 3 + 57 AS b_swapped, "
    "(steps * 2 + 57) - (steps * 3 + 57) AS filter_gap, (runs * 2 + 57) - (runs * 3 + 57) AS deflate_gap, steps * 2 - runs * 3 AS total_gap FROM f")


def _lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text", (F.col("n_chars") / 7).alias("share"))
    cells = [sinks.cell(d, c, 3 if c == "share" else None) for c in d.columns]
    return d.select("doc_id", sinks.csv_line(cells).alias("csv"), sinks.markdown_line(cells).alias("markdown"))


_CELL = ["CAST(doc_id AS VARCHAR)", "coalesce(source, '')", "coalesce(text, '')", "coalesce(printf('%.3f', n_chars / 7), '')"]
_QUOTED = [f"CASE WHEN regexp_matches({c}, '[,\"\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END" for c in _CELL]
_PIPED = [f"replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '|', '\\|'), chr(13) || chr(10), '<br>'), chr(13), '<br>'), chr(10), '<br>')" for c in _CELL]
QUERIES["s15_result_lines"] = _lines
SQL["s15_result_lines"] = "SELECT doc_id, " + " || ',' || ".join(_QUOTED) + " AS csv, '| ' || " + " || ' | ' || ".join(_PIPED) + " || ' |' AS markdown FROM documents"
