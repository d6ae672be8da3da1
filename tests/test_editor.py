"""Editor-side operators on cases worked out by hand, and codecs as queries."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from tilefold.functions import codecs, draws
from tilefold.operators import streams
from tilefold.plans import editor
from tilefold.plans import queries as plans
from tilefold.sources import png


def test_packed_streams_unpack(spark, sf_dir):
    for name, unpack in (("lz_gb_streams", codecs.un_lz_gb), ("zx0_streams", codecs.un_zx0)):
        rows = plans.QUERIES[name](spark, sf_dir).collect()
        assert rows and all(unpack(bytes.fromhex(r.packed)).hex() == r.raw for r in rows)


def test_tagged_tokens_are_the_codec(spark):
    rng = np.random.default_rng(2)
    data = {1: bytes([7]), 2: bytes([0] * 600 + [3, 3, 4]), 3: bytes(range(256)) + bytes([0, 0, 0, 9]), 4: bytes(rng.integers(0, 3, 500).tolist())}
    df = spark.createDataFrame([(k, i, v) for k, x in data.items() for i, v in enumerate(x)], "stream long, i long, v int")
    found = {}
    for r in streams.tagged_tokens(df).orderBy("stream", "start").collect():
        found[r.stream] = found.get(r.stream, "") + r.bytes
    assert found == {k: codecs.rle_nes(x).hex() for k, x in data.items()}


def test_draws_follow_the_state(spark):
    def sequence(seed, n):
        word = 0xFFFFFFFF
        for _ in range(n + 1):
            seed = (seed + 0x6D2B79F5) & word
        t = ((seed ^ seed >> 15) * (seed | 1)) & word
        t = (t + ((t ^ t >> 7) * (t | 61) & word) & word) ^ t
        return (t ^ t >> 14) / 2**32

    cases = [(s, n) for s in (0, 1, 12345, 2**31, 2**32 - 1) for n in (0, 1, 7, 1000)]
    df = spark.createDataFrame(cases, "seed long, n long").select("seed", "n", draws.draw(F.col("seed"), F.col("n")).alias("value"))
    assert {(r.seed, r.n): r.value for r in df.collect()} == {c: sequence(*c) for c in cases}


def test_options_and_names(spark):
    texts = [(None,), ("",), ("x",), (" 12px",), ("-3",), ("+7.9",), ("9" * 30,)]
    rows = spark.createDataFrame(texts, "t string").select(editor.clamped_option(F.col("t"), 1, 30, 8).alias("v")).collect()
    assert [r.v for r in rows] == [8, 8, 8, 12, 1, 7, 30]
    row = spark.range(1).select(
        editor.layer_name(F.lit("map"), F.lit("Ground & sky-2"), F.lit(2)).alias("several"),
        editor.layer_name(F.lit("map"), F.lit("Ground"), F.lit(1)).alias("one"),
        editor.export_name(F.lit("cat"), F.lit("nes"), F.lit("8"), F.lit("4"), F.lit("4"), F.lit("u")).alias("file"),
    ).first()
    assert tuple(row) == ("map_Ground_sky-2", "map", "cat-NES-8x8-4p4c-u.png")


def test_references(spark):
    refs = spark.createDataFrame([(1, "a\\b/Set.TSX"), (2, "gone.tsx"), (3, None)], "ref_id long, source string")
    files = spark.createDataFrame([("y/set.tsx",), ("x/SET.tsx",), (None,)], "path string")
    assert {r.ref_id: (r.file, r.code) for r in editor.resolved(refs, files).collect()} == {1: ("x/SET.tsx", None), 2: (None, "missing-file"), 3: (None, "missing-file")}


def test_training_pixels(spark):
    px = spark.createDataFrame([(1, 2, 3, 255), (1, 2, 3, 254), (0, 0, 0, 255)], "r int, g int, b int, a int")
    assert [editor.training_pixels(px, m, (1, 2, 3)).count() for m in ("all", "opaque", "key")] == [3, 2, 1]


def file_of(color, lines, height, width, extra=b""):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_true_color_by_every_filter():
    rng = np.random.default_rng(3)
    for color, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
        pixels = rng.integers(0, 256, (5, 6, n)).astype(np.uint8)
        lines, above = b"", np.zeros((6, n), np.int64)
        for y, row in enumerate(pixels.astype(np.int64)):
            left, corner = np.vstack([np.zeros((1, n), np.int64), row[:-1]]), np.vstack([np.zeros((1, n), np.int64), above[:-1]])
            base = left + above - corner
            near = np.select([(abs(base - left) <= abs(base - above)) & (abs(base - left) <= abs(base - corner)), abs(base - above) <= abs(base - corner)], [left, above], corner)
            lines += bytes([y]) + ((row - [0 * row, left, above, (left + above) // 2, near][y]) % 256).astype(np.uint8).tobytes()
            above = row
        got = png.decode_rgba(file_of(color, lines, 5, 6))
        assert (got[..., :3] == (pixels[..., :3] if n >= 3 else pixels[..., :1])).all()
        assert (got[..., 3] == (pixels[..., -1] if n in (2, 4) else 255)).all()


def test_true_color_files(spark, tmp_path):
    key = struct.pack(">I", 6) + b"tRNS" + struct.pack(">HHH", 1, 2, 3) + bytes(4)
    (tmp_path / "a.png").write_bytes(file_of(2, bytes([0, 1, 2, 3, 9, 8, 7]), 1, 2, key))
    (tmp_path / "b.png").write_bytes(png.encode(png.IndexedImage(1, 2, bytes([5, 6, 7]), bytes([0]), np.array([[0], [4]], np.uint8))))
    (tmp_path / "c.png").write_bytes(b"no image")
    images = png.decode_color_files(spark.read.format("binaryFile").load(str(tmp_path)))
    assert images.where("error is not null").count() == 1
    rows = {(r.path[-5], r.x, r.y): (r.r, r.g, r.b, r.a) for r in png.color_pixels(images).collect()}
    assert rows == {("a", 0, 0): (1, 2, 3, 0), ("a", 1, 0): (9, 8, 7, 255), ("b", 0, 0): (5, 6, 7, 0), ("b", 0, 1): (0, 0, 0, 255)}


def test_brightness_cuts_are_the_least_error(spark):
    from itertools import combinations

    rng = np.random.default_rng(4)
    cases = [[(7, 3)], [(1, 2), (9, 1)], [(1, 1), (2, 1), (3, 1)], [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1)]]
    cases += [[(int(b), int(rng.integers(1, 90))) for b in sorted(rng.choice(256, n, replace=False))] for n in (4, 6, 9)]

    def error(part):
        w, s = sum(n for _, n in part), sum(b * n for b, n in part)
        return sum(b * b * n for b, n in part) - s * s / w

    rows = []
    for k, bins in enumerate(cases):
        sums = np.cumsum([[0, 0, 0]] + [[n, b * n, b * b * n] for b, n in bins], axis=0).tolist()
        rows.append((k, [(i, *x) for i, x in enumerate(sums)]))
    df = spark.createDataFrame(rows, "k int, z array<struct<i:bigint,sw:bigint,s1:bigint,s2:bigint>>")
    for r in df.select("k", editor.brightness_cuts(F.col("z")).alias("cuts")).collect():
        bins, n = cases[r.k], len(cases[r.k])
        inner = [c for c in r.cuts[1:] if c < n]
        total = lambda cuts: sum(error(bins[a:b]) for a, b in zip([0, *cuts], [*cuts, n]))  # noqa: B023, B905, E731
        assert len(inner) == min(4, n) - 1 and inner == sorted(set(inner))
        assert abs(total(inner) - min(total(list(c)) for c in combinations(range(1, n), len(inner)))) < 1e-6
