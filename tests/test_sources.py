"""Image files, scans, baselines and rejected arguments."""

import struct
import zlib

import pytest

from pixelrel.operators import geometry, pixels, tones
from pixelrel.sources import images


def png(path, w, h, colour_type, data):
    """A PNG of unfiltered rows: colour type 2 is RGB, 6 RGBA, 0 grey."""
    step = {0: 1, 2: 3, 6: 4}[colour_type] * w
    raw = b"".join(b"\0" + data[k * step:(k + 1) * step] for k in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour_type, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    (root / "deep").mkdir()
    png(root / "b.png", 3, 2, 2, bytes(range(18)))
    png(root / "a.PNG", 2, 2, 6, bytes(range(100, 116)))
    png(root / "deep" / "c.png", 4, 1, 0, bytes([7, 8, 9, 10]))
    (root / "broken.png").write_bytes(b"no picture")
    (root / "notes.txt").write_text("x")
    (root / "d.jpg").write_bytes(b"no picture either")
    return root


def test_pixels_of_files_of_all_sizes(spark, folder):
    found = images.read_images(spark, str(folder))
    got = {r["image_id"].rsplit("/", 1)[1]: (r["w"], r["h"]) for r in found.where("w is not null").collect()}
    assert got == {"b.png": (3, 2), "a.PNG": (2, 2), "c.png": (4, 1)}
    px = {(r["image_id"].rsplit("/", 1)[1], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in images.to_pixels(found).collect()}
    assert len(px) == 14 and px["b.png", 1, 1] == (12, 13, 14, 255) and px["a.PNG", 0, 1] == (108, 109, 110, 111) and px["c.png", 3, 0] == (10, 10, 10, 255)


def test_operators_keep_each_images_size(spark, folder):
    px = images.to_pixels(images.read_images(spark, str(folder)))
    out = geometry.fit(px, "contain", (6, 4), (0, 0, 0, 255)).toPandas()
    assert out.groupby("image_id").size().tolist() == [24, 24, 24]
    wide = geometry.resize(px, geometry.target_size("width", 8)).toPandas().drop_duplicates("image_id")
    assert sorted(zip(wide.w, wide.h)) == [(8, 2), (8, 5), (8, 8)]


def test_scan(spark, folder):
    names = lambda **k: [r["path"].rsplit("/", 1)[1] for r in images.scan(spark, str(folder), **k).collect()]
    assert names() == ["a.PNG", "b.png", "broken.png", "d.jpg", "c.png"] and names(formats=["png"], limit=2) == ["a.PNG", "b.png"]
    with pytest.raises(ValueError):
        images.scan(spark, str(folder), formats=["webp"])


def test_baseline_file(spark, tmp_path):
    path = tmp_path / "baseline.json"
    path.write_text('{"comment": "x",\n "fixtures": {"a.png": {"input_bytes": 9, "tinypng_bytes": 4}, "b.png": {"tinypng_bytes": 5}}, "totals": {}}')
    assert sorted(map(tuple, images.baseline(spark, str(path)).collect())) == [("a.png", 4), ("b.png", 5)]


def test_rejected_arguments(spark, folder):
    px = images.to_pixels(images.read_images(spark, str(folder)))
    for call in (lambda: geometry.target_size("scale", float("nan")), lambda: geometry.crop(px, 0, 0, 0, 3), lambda: geometry.circle_mask(px, 0), lambda: geometry.fit_size("stretch", 2, 2),
                 lambda: tones.gaussian_blur(px, -1), lambda: tones.unsharp(px, 0), lambda: tones.median(px, 11), lambda: tones.assign_palette(px, []), lambda: geometry.watermark(px, px, 0), lambda: pixels.mock(px, "dots", (0, 0, 0, 0))):
        with pytest.raises(ValueError):
            call()
    # A rectangle outside an image leaves it without rows; radius 0 and sigma 0 change nothing.
    assert geometry.crop(px, 50, 0, 5, 5).count() == 0
    assert sorted(map(tuple, tones.median(px, 0).collect())) == sorted(map(tuple, px.collect())) and tones.gaussian_blur(px, 0) is px


def test_feather_beyond_the_radius_shrinks_to_it(spark):
    px = pixels.mock(spark.createDataFrame([(1, 8, 8)], "image_id int, w int, h int"), "solid", (1, 2, 3, 255))
    wide, full = (geometry.circle_mask(px, 3, f).toPandas() for f in (50, 3))
    assert (wide.a == full.a).all() and geometry.circle_mask(px, 3, 0).toPandas().a.isin([0, 255]).all()
