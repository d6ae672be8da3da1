"""Sinks: files from ordered parts, images from bands, read back by the decoders."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilefold.sources import png, sinks


def written(parts, folder):
    sinks.write_files(parts, str(folder))
    assert not os.path.exists(folder / "_temporary")
    return {n: (folder / n).read_bytes() for n in os.listdir(folder)}


def test_files_from_parts(spark, tmp_path):
    rows = [("a.bin", n, bytes([n] * 50)) for n in range(30)] + [("b.bin", 7, b"x"), ("b.bin", -1, b"yy"), ("c.bin", 0, b"")]
    random.Random(1).shuffle(rows)
    got = written(spark.createDataFrame(rows, "file string, nth int, data binary").repartition(5), tmp_path / "out")
    assert got == {"a.bin": b"".join(bytes([n] * 50) for n in range(30)), "b.bin": b"yyx", "c.bin": b""}
    again = written(spark.createDataFrame([("b.bin", 0, b"new")], "file string, nth int, data binary"), tmp_path / "out")
    assert again["b.bin"] == b"new" and len(again) == 3


def test_failed_job_leaves_nothing(spark, tmp_path):
    bad = spark.range(8).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.lit(0).alias("nth"), F.when(F.col("id") == 6, F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.lit(b"1")).alias("data"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_files(bad, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []


def image(rng, tiles_x, tiles_y, entries):
    return np.array([[rng.randrange(entries) for _ in range(tiles_x * 8)] for _ in range(tiles_y * 8)])


def cells_of(name, pixels):
    h, w = pixels.shape
    return [(name, y * (w // 8) + x, pixels[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].ravel().tolist()) for y in range(h // 8) for x in range(w // 8)]


@pytest.mark.parametrize("transparent", [False, True])
def test_indexed_and_fallback(spark, tmp_path, transparent):
    rng = random.Random(4)
    art = {"one.png": (image(rng, 5, 3, 9), 9), "two.png": (image(rng, 2, 2, 300), 300), "three.png": (image(rng, 1, 4, 256), 256)}
    colors = {n: [tuple(rng.randrange(256) for _ in range(3)) for _ in range(k)] for n, (_, k) in art.items()}
    cells = spark.createDataFrame([c for n, (p, _) in art.items() for c in cells_of(n, p)], "file string, cell long, pixels array<int>").repartition(4)
    palettes = spark.createDataFrame([(n, i, *c) for n, x in colors.items() for i, c in enumerate(x)], "file string, entry int, r int, g int, b int")
    sizes = spark.createDataFrame([(n, p.shape[1] // 8, p.shape[0] // 8) for n, (p, _) in art.items()], "file string, tiles_x int, tiles_y int")
    got = written(sinks.indexed_images(cells, palettes, sizes, transparent), tmp_path / "png")
    assert set(got) == set(art)
    for n, (p, k) in art.items():
        shown = png.decode_rgba(got[n])
        assert (shown[..., :3] == np.array(colors[n], np.uint8)[p]).all()
        if k <= 256:
            back = png.decode(got[n])
            assert (back.indexes == p).all() and len(back.palette) == 3 * k and back.alpha == (b"\x00" if transparent else None)
        else:
            assert got[n][25] == 2  # RGB


def test_missing_cells_are_zero(spark, tmp_path):
    cells = spark.createDataFrame([("a.png", 3, [1] * 64)], "file string, cell long, pixels array<int>")
    palettes = spark.createDataFrame([("a.png", 0, 9, 9, 9), ("a.png", 1, 1, 2, 3)], "file string, entry int, r int, g int, b int")
    sizes = spark.createDataFrame([("a.png", 2, 2)], "file string, tiles_x int, tiles_y int")
    lines = cells.unionByName(cells.withColumn("cell", F.lit(1)))
    back = png.decode(written(sinks.indexed_images(lines, palettes, sizes), tmp_path / "x")["a.png"])
    assert back.indexes[:, :8].sum() == 0 and back.indexes[:, 8:].all()


def test_strips_and_sheets(spark, tmp_path):
    rows = [("p.png", p, i, 10 * p, i, 7) for p in range(3) for i in range(4)] + [("wide.png", 0, i, i, 0, 0) for i in range(100)]
    got = written(sinks.palette_strips(spark.createDataFrame(rows, "file string, palette int, i int, r int, g int, b int")), tmp_path / "p")
    strip = png.decode_rgba(got["p.png"])
    assert strip.shape[:2] == (24, 32) and (strip[8:16, 8:16, :3] == (10, 1, 7)).all()
    assert png.decode_rgba(got["wide.png"]).shape[:2] == (8, 600) and png.decode_rgba(got["wide.png"])[0, 599, 0] == 99
    tiles = spark.createDataFrame([("t.png", t, [t << 16 | 5] * 64) for t in range(19)], "file string, tile int, pixels array<int>")
    sheet = png.decode_rgba(written(sinks.sheets(tiles), tmp_path / "t")["t.png"])
    assert sheet.shape[:2] == (16, 128) and (sheet[8:, 16:24, :3] == (18, 0, 5)).all() and not sheet[8:, 24:, :3].any()


def test_hex_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "chr", "00ff"), (1, "pal", "0f")], "image_id int, file string, data string")
    assert written(sinks.hex_files(rows, F.concat(F.lit("img"), F.col("image_id"), F.lit("."), F.col("file"))), tmp_path / "h") == {"img1.chr": b"\x00\xff", "img1.pal": b"\x0f"}
