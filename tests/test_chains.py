"""Operators that chain many steps, beyond what the queries show: odd shapes, broken files, bounds, ties."""

import csv
import io
import itertools
import math
import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelrel.operators import analytics, content, filters, geometry, metrics, ordered, palettes, pixels, search, tones
from pixelrel.sources import chunks, images, sinks

PIXELS = "image_id long, w long, h long, x long, y long, r long, g long, b long, a long"


def picture(spark, arrays, parts=3):
    rows = [(i, a.shape[1], a.shape[0], x, y, *map(int, a[y, x])) for i, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, PIXELS).repartition(parts)


# ---- median cut ------------------------------------------------------------------------------------------------------------------


def brute_cut(a, k):
    colours, n = np.unique(a.reshape(-1, 4), axis=0, return_counts=True)
    boxes = [np.arange(len(colours))]
    for _ in range((k - 1).bit_length()):
        spread = [(colours[b].max(0) - colours[b].min(0)) for b in boxes]
        order = sorted(range(len(boxes)), key=lambda i: (spread[i].max() == 0, -n[boxes[i]].sum() * spread[i].max(), i))
        split = {i for i in order[:k - len(boxes)] if spread[i].max() > 0}
        out = []
        for i, box in enumerate(boxes):
            if i not in split:
                out.append(box)
                continue
            c = int(np.argmax(spread[i]))
            v = colours[box, c]
            values = np.unique(v)
            cut = next(x for x in values if 2 * n[box[v <= x]].sum() >= n[box].sum())
            cut = values[-2] if cut == values[-1] else cut
            out += [box[v <= cut], box[v > cut]]
        boxes = out
    mean = lambda box, c: int((2 * (n[box] * colours[box, c]).sum() + n[box].sum()) // (2 * n[box].sum()))
    return [(i, *[mean(b, c) for c in range(4)], int(n[b].sum())) for i, b in enumerate(boxes)]


@pytest.mark.parametrize("k", [2, 5, 16])
def test_median_cut_is_that_of_each_image_alone(spark, k):
    rng = np.random.default_rng(k)
    arrays = [rng.integers(0, 256, (9, 13, 4)), np.full((4, 4, 4), 7), rng.integers(0, 2, (6, 5, 4)) * 255, np.concatenate([np.zeros((1, 30, 4), int), rng.integers(0, 9, (1, 30, 4))])]
    got = palettes.median_cut(picture(spark, arrays), k).collect()
    for i, a in enumerate(arrays):
        assert sorted(tuple(r)[1:] for r in got if r["image_id"] == i) == brute_cut(a, k)


def test_trained_palettes_fill_up_and_refine(spark):
    px = picture(spark, [np.full((4, 4, 4), 200), np.random.default_rng(1).integers(0, 256, (8, 8, 4))])
    first = palettes.trained_palettes(px, 6)
    rows = first.collect()
    assert sorted((r["image_id"], r["idx"]) for r in rows) == [(i, j) for i in (0, 1) for j in range(6)]
    one = [tuple(r)[2:] for r in rows if r["image_id"] == 0]
    assert len(set(one)) == 1 and one[0][3] == 200
    better = tones.refine_palettes(px, first, 3)
    assert better.count() == 12
    error = lambda p: px.where("image_id = 1").crossJoin(F.broadcast(p.where("image_id = 1").select(*[F.col(c).alias(f"p_{c}") for c in ("ok_l", "ok_a", "ok_b", "alpha")]))).transform(tones.with_oklab).groupBy("x", "y").agg(
        F.min((F.col("ok_l") - F.col("p_ok_l")) ** 2 + (F.col("ok_a") - F.col("p_ok_a")) ** 2 + (F.col("ok_b") - F.col("p_ok_b")) ** 2 + ((F.col("a") - F.col("p_alpha")) * tones.ALPHA_SCALE) ** 2).alias("d")).agg(F.sum("d")).first()[0]
    assert error(better) <= error(first)
    assert palettes.median_cut(px.where("false"), 4).count() == 0
    with pytest.raises(ValueError):
        palettes.median_cut(px, 1)


# ---- likeness -------------------------------------------------------------------------------------------------------------------


def test_equal_pictures_score_100_and_worse_ones_less(spark):
    rng = np.random.default_rng(3)
    a = np.kron(rng.integers(60, 200, (5, 6, 3)), np.ones((4, 4, 1))).astype(int)
    a = np.concatenate([a, np.full((*a.shape[:2], 1), 255)], axis=2)
    noisy = lambda s: np.clip(a + rng.integers(-s, s + 1, a.shape), 0, 255)
    small = a[:7, :30]
    score = lambda left, right: {r["image_id"]: (r["scales"], r["score"]) for r in metrics.likeness(picture(spark, left), picture(spark, right)).collect()}
    got = score([a, a, a, small, a], [a, noisy(3), noisy(40), small, a[:, :20]])
    # Below eight pixels, or of other size: no row. 24 x 20 has scales of 20, 10 and 5 rows.
    assert set(got) == {0, 1, 2} and got[0] == (3, 100.0) and got[0][1] > got[1][1] > got[2][1]


def test_moments_weigh_the_square_and_nothing_beyond(spark):
    v = np.random.default_rng(0).random((2, 5, 9))
    rows = [(0, 0, x, y, float(v[0, y, x]), float(v[1, y, x])) for y in range(5) for x in range(9)]
    got = metrics.moments(spark.createDataFrame(rows, "image_id int, plane int, x int, y int, v1 double, v2 double")).collect()
    w = {d: metrics.SMOOTH[abs(d)] for d in range(-4, 5)}
    for r in got:
        square = [(w[i] * w[j], v[0, r["y"] + j, r["x"] + i], v[1, r["y"] + j, r["x"] + i]) for i in w for j in w if 0 <= r["x"] + i < 9 and 0 <= r["y"] + j < 5]
        assert abs(r["mu1"] - sum(f * p for f, p, _ in square)) < 1e-12 and abs(r["s12"] - sum(f * p * q for f, p, q in square)) < 1e-12


# ---- files ------------------------------------------------------------------------------------------------------------------------


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pieces, extra=b"", end=True):
    return chunks_head() + extra + b"".join(chunk(b"IDAT", p) for p in pieces) + (chunk(b"IEND", b"") if end else b"")


def chunks_head():
    return bytes.fromhex(chunks.SIGNATURE) + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 4, 8, 3, 0, 0, 0))


def test_walks_of_good_and_broken_files(spark):
    rng = random.Random(1)
    many = [bytes(rng.randrange(256) for _ in range(rng.randrange(6))) for _ in range(90)]
    good = png(many, chunk(b"PLTE", bytes(9)) + chunk(b"tRNS", b"\1\2"))
    files = {
        "good": good, "cut": good[:-20], "overrun": chunks_head() + chunk(b"IDAT", bytes(100))[:60], "tail": good + b"behind the end" * 3, "noend": png([b"abc"], end=False), "short": bytes.fromhex(chunks.SIGNATURE), "stub": chunks_head()[:19],
        "text": b"no picture at all, but long enough", "empty": b"", "null": None, "odd": chunks_head() + chunk(b"\xff\x00ab", b"x") + chunk(b"IEND", b""), "huge": chunks_head() + b"\xff\xff\xff\xffIDAT" + bytes(40),
    }
    frame = spark.createDataFrame(list(files.items()), "file string, content binary").repartition(4)
    for block in (512, 7):
        walked = chunks.walk_chunks(frame, block=block)
        rows = walked.collect()
        for name, data in files.items():
            own = sorted((r["chunk_no"], r["type"], r["start"], r["length"], r["error"]) for r in rows if r["file"] == name and r["chunk_no"] is not None)
            assert [tuple(r)[2:] for r in rows if r["file"] == name and r["error"] == "signature"] == ([(None,) * 4 + ("signature",)] if data is None or not data.startswith(bytes.fromhex(chunks.SIGNATURE)) else [])
            at, want = 8, []
            while data is not None and data.startswith(bytes.fromhex(chunks.SIGNATURE)) and at + 12 <= len(data):
                size, kind = struct.unpack(">I", data[at:at + 4])[0], data[at + 4:at + 8]
                want.append((len(want), "".join(chr(b) if b < 128 else "�" for b in kind), at + 8, size, "overrun" if at + 12 + size > len(data) else None))
                at += 12 + size
                if kind == b"IEND":
                    break
            assert own == want, name
    figures = {r["file"]: r for r in chunks.chunk_figures(walked).collect()}
    assert tuple(figures["good"])[1:] == (3, 3, 2, sum(map(len, many)), 94, None) and figures["overrun"]["error"] == "overrun" and figures["text"]["error"] == "signature"
    streams = {r["file"]: (r["size"], r["stream"] and bytes(r["stream"]), r["error"]) for r in chunks.stream_of(frame, walked).collect()}
    assert streams["good"] == streams["tail"] == (len(b"".join(many)), b"".join(many), None) and streams["noend"] == (3, b"abc", None) and streams["odd"] == (0, b"", None)
    assert streams["overrun"][1:] == (None, "overrun") and streams["huge"][1:] == (None, "overrun")
    assert [r["error"] for r in chunks.stream_of(frame, walked, bound=10).where("file = 'good'").collect()] == ["too large"]
    assert chunks.walk_chunks(frame.where("false")).count() == 0


def test_files_are_identified_by_their_bytes(spark, tmp_path):
    files = {"a.txt": png([b"x"]), "b.gif": b"GIF89a" + struct.pack("<HH", 300, 2) + bytes(9), "c.bmp": b"BM" + bytes(16) + struct.pack("<ii", 70, 80) + bytes(9), "d.jpg": b"\xff\xd8\xff\xe0" + bytes(9),
             "e.webp": b"RIFF\1\2\3\4WEBPVP8 ", "f.tif": b"II*\0" + bytes(9), "g.png": b"garbage", "i.gif": b"GIF89a"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {Path(r["file"]).name: tuple(r)[1:] for r in images.identify(images.read_files(spark, str(tmp_path))).collect()}
    bad = (None, None, None, "codec")
    assert got == {"a.txt": ("png", 5, 4, None), "b.gif": ("gif", 300, 2, None), "c.bmp": ("bmp", 70, 80, None), "d.jpg": ("jpeg", None, None, None), "e.webp": ("webp", None, None, None), "f.tif": ("tiff", None, None, None), "g.png": bad, "i.gif": bad}
    rest = images.identify(spark.createDataFrame([("empty", b""), ("null", None)], "file string, content binary"))
    assert sorted(map(tuple, rest.collect())) == [("empty", *bad), ("null", *bad)]


def lines(folder):
    return "".join(p.read_bytes().decode() for p in sorted(Path(folder).glob("part-*")))


def test_result_tables_are_read_back(spark, tmp_path):
    rows = [(3, "plain", 1.23456, None), (1, 'quote " and, comma', float("nan"), 5), (2, "line\nbreak | pipe \\ back", None, -7), (2, "line\r\nbreak | pipe \\ back", 2.0, 8), (None, "", 0.5, 0)] * 1 + [(10 + i, f"row {i}", i / 3, i) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, `te,xt` string, score double, n long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_csv(frame, str(tmp_path / "csv"), ["id"], {"score": 3})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = list(csv.reader(io.StringIO(lines(tmp_path / "csv"), newline="")))
    assert read[0] == ["id", "te,xt", "score", "n"] and (tmp_path / "csv" / "_SUCCESS").exists() and len(list((tmp_path / "csv").glob("part-*"))) > 1
    text = lambda v, d=None: "" if v is None else "nan" if v != v else f"{v:.{d}f}" if d else str(v)
    assert sorted(read[1:]) == sorted([text(i), t, text(s, 3), text(n)] for i, t, s, n in rows)
    ids = [int(r[0] or -1) for r in read[1:]]
    assert ids == sorted(ids)
    sinks.write_markdown(frame, str(tmp_path / "md"), ["id", "n"], {"score": 2}, right=["score", "n"], title="Results")
    table = lines(tmp_path / "md").split("\n")
    assert table[:4] == ["# Results", "", "| id | te,xt | score | n |", "|---|---|---:|---:|"] and len([x for x in table[4:] if x]) == len(rows)
    assert "| 2 | line<br>break \\| pipe \\\\ back |  | -7 |" in table and "| 2 | line<br>break \\| pipe \\\\ back | 2.00 | 8 |" in table
    sinks.write_csv(frame.where("false"), str(tmp_path / "none"), ["id"])
    assert lines(tmp_path / "none") == 'id,"te,xt",score,n\n'


# ---- search, running totals, sizes --------------------------------------------------------------------------------------------------


def test_search_is_a_bisection_of_each_row(spark):
    rng = random.Random(4)
    trials, rows = {}, []
    for i in range(60):
        curve = sorted((rng.uniform(0, 10) for _ in range(91)), reverse=True)
        for q in range(10, 101):
            if not (i % 10 == 0 and rng.random() < 0.3):
                trials[i, q] = (float("nan") if i % 7 == 0 and q % 5 == 0 else None if i % 11 == 0 and q % 3 == 0 else curve[q - 10] + rng.uniform(-1, 1) * (i % 2), q * 10 + i)
        rows.append((i, None if i == 59 else rng.uniform(-1, 11)))
    rows.append((99, 5.0))
    found = search.quality_search(spark.createDataFrame(rows, "id int, target double"), spark.createDataFrame([(i, q, s, z) for (i, q), (s, z) in trials.items()], "id int, q int, score double, size long"), True)
    got = {r["id"]: tuple(r)[1:] for r in found.collect()}
    for i, target in rows:
        lo, hi, best, last, tried = 10, 100, None, None, 0
        while lo <= hi:
            q = (lo + hi) // 2
            trial = trials.get((i, q))
            tried += trial is not None
            last = q if trial else last
            if trial and target is not None and trial[0] is not None and trial[0] == trial[0] and trial[0] <= target:
                best, hi = q, q - 1
            else:
                lo = q + 1
        q = best if best is not None else last
        want = (q, *(trials[i, q] if q else (None, None)), best is not None, tried)
        assert got[i] == want or str(got[i]) == str(want)
    assert sorted(q for level in search._levels(10, 100) for q in level) == list(range(10, 101))


@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals_cross_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot"] * 8 + ["b", "c", None]), i, rng.randint(-5, 5)) for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = ordered.running(spark.createDataFrame(rows, "k string, i int, v int"), "k", ["i"], {"s": "v"}, {"m": "v"}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    sums, tops = {}, {}
    want = []
    for k, i, v in rows:
        want.append((k, i, v, sums.get(k, 0) + v, tops.get(k)))
        sums[k], tops[k] = sums.get(k, 0) + v, max(v, tops.get(k, v))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(g, None if x > 2 else float(x)) for g, n in (("a", 1001), ("b", 1), ("c", 50)) for x in rng.normal(size=n)] + [("d", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in analytics.percentiles(frame, "g", "v", {"p0": 0.0, "p37": 0.37, "p100": 1.0}).collect()}
    for g in "abc":
        own = [v for k, v in rows if k == g and v is not None]
        assert np.allclose(got[g], np.percentile(own, [0, 37, 100]))
    assert "d" not in got


def test_size_matrix_with_gaps(spark):
    rows = [("x", "A", "total", 10), ("x", "B", "total", 14), ("x", "B", "total", 13), ("x", "B", "swapped", 12), ("y", "A", "idat", 3)]
    got = {r["f"]: r.asDict() for r in analytics.size_matrix(spark.createDataFrame(rows, "f string, p string, s string, n long"), "f", "p", "s", "n").collect()}
    assert (got["x"]["filter_gap"], got["x"]["total_gap"], got["x"]["deflate_gap"]) == (2, 4, None) and got["y"]["a_idat"] == 3 and got["y"]["total_gap"] is None


# ---- the rest -----------------------------------------------------------------------------------------------------------------------


def test_long_streams_run_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(content, "STREAM_BLOCK", 50)
    rng = random.Random(6)
    values = [rng.choice([0, 0, 0, 1]) for _ in range(1000)]
    frame = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)] + [("one", 70, 3)], "k string, i long, v long")
    got = {r["k"]: (r["n"], r["run_length"]) for r in content.byte_run_length(frame, "k", "i", "v").collect()}
    assert got == {"k": (1000, 1000 / (1 + sum(a != b for a, b in zip(values, values[1:])))), "one": (1, 1.0)}


def test_adler_of_far_positions(spark):
    data = bytes(random.Random(7).randrange(256) for _ in range(5000))
    frame = spark.createDataFrame([("k", i, v) for i, v in enumerate(data)], "k string, i long, v long")
    assert content.adler32(frame, "k", "i", "v").first()["adler32"] == zlib.adler32(data)
    far = spark.range(3).select(F.lit("k").alias("k"), (F.col("id") + (1 << 40)).alias("i"), F.lit(255).cast("long").alias("v"))
    assert content.adler32(far, "k", "i", "v").count() == 1


def test_logos_beyond_the_bound_are_the_same(spark):
    rng = np.random.default_rng(8)
    canvas, logo = picture(spark, [rng.integers(0, 256, (8, 9, 4)), rng.integers(0, 256, (8, 9, 4)), rng.integers(0, 256, (5, 12, 4))]), picture(spark, [rng.integers(0, 256, (3, 4, 4))])
    small, large = (geometry.watermark(canvas, logo, 0.5, bound=b).collect() for b in (1 << 21, 2))
    assert sorted(map(tuple, small)) == sorted(map(tuple, large)) and len(small) == canvas.count()


def test_images_of_unlike_width(spark):
    top, bottom = picture(spark, [np.zeros((2, 3, 4), int), np.zeros((2, 3, 4), int)]), picture(spark, [np.zeros((1, 3, 4), int), np.zeros((1, 2, 4), int), np.zeros((1, 1, 4), int)])
    assert sorted(map(tuple, geometry.unlike_widths(top, bottom).collect()), key=str) == [(1, 3, 2), (2, None, 1)]
    assert geometry.concat_vertical(top, bottom).count() == 9
    with pytest.raises(ValueError):
        geometry.concat_vertical(top, bottom, strict=True)


def test_images_that_a_rectangle_leaves_empty(spark):
    px = picture(spark, [np.zeros((4, 8, 4), int), np.zeros((6, 3, 4), int)])
    left = lambda *rect: sorted(r["image_id"] for r in geometry.cropped_away(px, *rect).collect())
    assert left(3, 0, 2, 2) == [1] and left(0, 4, 2, 2) == [0] and left(-2, 0, 2, 9) == [0, 1] and left(0, 0, 0, 5) == [0, 1] and left(-1, -1, 2, 2) == []
    kept = {r["image_id"] for r in geometry.crop(px, 3, 0, 2, 2).collect()}
    assert kept == {0}


def test_filters_by_kind(spark):
    px = picture(spark, [np.random.default_rng(9).integers(0, 256, (6, 7, 4))])
    same = lambda a, b: sorted(map(tuple, a.select(px.columns).collect())) == sorted(map(tuple, b.select(px.columns).collect()))
    assert same(filters.apply_filter(px, "blur"), tones.gaussian_blur(px, 1.5)) and same(filters.apply_filter(px, "hue"), tones.hue_rotate(px, 90)) and same(filters.apply_filter(px, "sharpen", 0.7), tones.unsharp(px, 0.7))
    assert same(filters.apply_filter(px, "invert"), pixels.invert(px)) and same(filters.denoise(px, "gaussian", 0.8), tones.gaussian_blur(px, 0.8)) and same(filters.denoise(px, "median", 1.5), tones.median(px, 2))
    for call in (lambda: filters.apply_filter(px, "sepia"), lambda: filters.apply_filter(px, "blur", float("nan")), lambda: filters.denoise(px, "median", 10.5), lambda: filters.denoise(px, "mean", 1)):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("radius", [1, 3, 10])
def test_medians_across_blocks_of_rows(spark, monkeypatch, radius):
    monkeypatch.setattr(tones, "MEDIAN_ROWS", 4)
    rng = np.random.default_rng(radius)
    arrays = [rng.integers(0, 256, (13, 6, 4)), rng.integers(0, 256, (4, 1, 4)), rng.integers(0, 256, (1, 9, 4)), rng.integers(0, 256, (9, 30, 4))]
    frame = picture(spark, arrays).withColumn("note", F.concat_ws("-", "x", "y"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if radius == 1 else 23)
    try:
        got = {(r["image_id"], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"], r["note"]) for r in tones.median(frame, radius).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(a.shape[0] * a.shape[1] for a in arrays)
    for i, a in enumerate(arrays):
        wide = np.pad(a, ((radius, radius), (radius, radius), (0, 0)), mode="edge")
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                square = wide[y:y + 2 * radius + 1, x:x + 2 * radius + 1].reshape(-1, 4)
                assert got[i, x, y] == (*np.median(square, axis=0).astype(int).tolist(), f"{x}-{y}")


# ---- sums in any order --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_sums_are_rounded_once(spark, parts):
    rng = random.Random(parts)
    groups = {
        "shares": [255 / (8 + rng.randrange(900)) for _ in range(3000)], "pair": [188 * 0.21052631578947367, 182 * 0.14035087719298245], "cancel": [1e9 + 0.1, 2.0 ** -50, -1e9, 0.3, -0.1, -2.0 ** -53],
        "tiny": [rng.random() * 1e-8 for _ in range(500)], "mixed": [rng.uniform(-1, 1) * 10 ** rng.randrange(-3, 6) for _ in range(2000)], "large": [3e300, 1.0], "one": [-0.7], "null": [None], "gap": [None, 0.1, 0.2, 0.3],
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    rng.shuffle(rows)
    got = dict(map(tuple, spark.createDataFrame(rows, "k string, v double").repartition(parts).groupBy("k").agg(tones.exact_sum(F.col("v"))).collect()))
    assert got == {k: math.fsum(v for v in values if v is not None) if k != "null" else None for k, values in groups.items()}
    odd = spark.createDataFrame([("a", math.nan), ("a", 1.0), ("b", math.inf), ("b", 0.5), ("c", math.inf), ("c", -math.inf)], "k string, v double").groupBy("k").agg(tones.exact_sum(F.col("v"))).collect()
    assert {k: str(v) for k, v in odd} == {"a": "nan", "b": "inf", "c": "nan"}


def test_weighted_alpha_is_the_same_in_any_order(spark):
    # Three and four pixels of one entry whose weighted mean alpha lies halfway: summed one by one, the order decides where it is rounded to.
    cases = [([188, 180, 182], [0.21052631578947367, 0.21052631578947367, 0.14035087719298245]), ([188, 190, 182, 0], [1 / 7.5, 1 / 9.5, 1 / 4.5, 1 / 4500])]
    rows, want, image = [], {}, 0
    for alphas, weights in cases:
        for order in itertools.permutations(range(len(alphas))):
            rows += [(image, len(order), 1, x, 0, 9, 9, 9, alphas[k], weights[k]) for x, k in enumerate(order)]
            want[image] = math.floor(math.fsum(a * w for a, w in zip(alphas, weights)) / math.fsum(weights) + 0.5)
            image += 1
    px = spark.createDataFrame(rows, f"{PIXELS}, weight double").coalesce(1)
    got = tones.refine_palettes(px, tones.palettes_of(px, [(9, 9, 9, 200)]), 1, weight="weight").collect()
    assert {r["image_id"]: r["alpha"] for r in got} == want
