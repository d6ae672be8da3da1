"""The quantizer with several palettes and the renderer, against plain loops on small images."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tilefold import model
from tilefold.operators import quantizer as qz


def image(rng, tiles, width=8):
    """Tiles of few colours each, some transparent pixels, one tile without any visible one."""
    schemes = [[rng.randrange(1 << 24) for _ in range(4)] for _ in range(3)]
    out = []
    for t in range(tiles):
        s = rng.choice(schemes)
        out.append([-1 if t == 2 or rng.random() < 0.05 else s[rng.randrange(4)] ^ rng.randrange(4) for _ in range(width * width)])
    return out


def blocks_of(spark, images):
    rows = [(i, c, 3, pixels) for i, tiles in images.items() for c, pixels in enumerate(tiles)]
    return qz.blocks(spark.createDataFrame(rows, "image_id long, cell long, tiles_x long, pixels array<int>").repartition(3))


def levels(c):
    return (c >> 16 & 255, c >> 8 & 255, c & 255)


def dist(a, b):
    return sum(w * (x - y) ** 2 for w, x, y in zip((2, 4, 1), levels(a), levels(b), strict=True))


def nearest(palette, c, skip=None):
    """(distance, index) of the nearest colour, the last of equals."""
    return min((dist(c, k), -i) for i, k in enumerate(palette) if i != skip)


def brute_stats(tiles, palettes):
    stats, choice = {}, {}
    for t, pixels in enumerate(tiles):
        seen = [c for c in pixels if c >= 0]
        if not seen:
            continue
        totals = [sum(nearest(p, c)[0] for c in seen) for p in palettes]
        best = totals.index(min(totals))
        choice[t] = (best, totals)
        s = stats.setdefault((best, -1), {"n": 0, "error": 0, "removed": 0, "worst": (-1, 0)})
        s["n"] += len(seen)
        s["error"] += totals[best]
        s["removed"] += min((x for p, x in enumerate(totals) if p != best), default=0)
        s["worst"] = max(s["worst"], (totals[best], -t))
        for c in seen:
            d, i = nearest(palettes[best], c)
            k = stats.setdefault((best, -i), {"n": 0, "sr": 0, "sg": 0, "sb": 0, "error": 0, "removed": 0, "far": (-1, 0)})
            k["n"] += 1
            for name, v in zip(("sr", "sg", "sb"), levels(c), strict=True):
                k[name] += v
            k["error"] += d
            k["removed"] += nearest(palettes[best], c, -i)[0] if len(palettes[best]) > 1 else 0
            k["far"] = max(k["far"], (d, -c))
    for (_, c), s in stats.items():
        if c < 0:
            pixels = [x for x in tiles[-s["worst"][1]] if x >= 0]
            common = sorted(set(pixels), key=lambda x: (-pixels.count(x), x))[: len(palettes[0])]
            s["tile_colors"] = common + common[:1] * (len(palettes[0]) - len(common))
        else:
            s["far_rgb"] = -s["far"][1]
    return stats


def brute_train(tiles, palettes, colors, rounds, means, shared):
    now, best, error = [([] if shared is None else [shared]) + [0]], None, None
    for step in qz.schedule(palettes, colors, rounds, means, shared is not None):
        stats = brute_stats(tiles, now)
        total = sum(s["error"] for (_, c), s in stats.items() if c < 0)
        if len(now) == palettes and len(now[0]) == colors and (best is None or total < error):
            best, error = [list(p) for p in now], total
        now = [list(p) for p in best] if step == "best" else qz.next_palettes(step, now, stats, shared is not None)
    return best, error


@pytest.mark.parametrize("palettes,colors,shared,rounds", [(3, 4, None, 3), (1, 5, None, 2), (2, 3, 0x102030, 2)])
def test_train(spark, palettes, colors, shared, rounds):
    rng = random.Random(palettes)
    images = {7: image(rng, 20), 9: image(rng, 5), 11: [[-1] * 64]}
    got = {r.image_id: r for r in qz.train(blocks_of(spark, images), palettes, colors, rounds, 2, shared).collect()}
    assert set(got) == {7, 9}
    for i, r in got.items():
        best, error = brute_train(images[i], palettes, colors, rounds, 2, shared)
        assert (r.palettes, r.error, r.pixels) == ([c for p in best for c in p], error, sum(c >= 0 for t in images[i] for c in t))
        assert shared is None or all(p[0] == shared for p in best)


def test_blocks_do_not_matter(spark, monkeypatch):
    tiles = image(random.Random(4), 30)
    one = qz.train(blocks_of(spark, {1: tiles}), 2, 4, 2, 1).collect()
    monkeypatch.setattr(qz, "BLOCK_TILES", 4)
    monkeypatch.setattr(qz, "BROADCAST_COLORS", 0)
    assert qz.train(blocks_of(spark, {1: tiles}), 2, 4, 2, 1).collect() == one


def test_replacements():
    stats = {(0, -1): {"error": 100, "removed": 900, "tile_colors": [5, 6]}, (0, 0): {"n": 1, "sr": 9, "sg": 9, "sb": 9, "error": 90, "removed": 500, "far_rgb": 77}, (0, 1): {"n": 2, "sr": 3, "sg": 0, "sb": 0, "error": 10, "removed": 20, "far_rgb": 1}}
    # colour 1 costs 20 to remove, less than half of 90; palette 1 has no tile, so its removal costs nothing
    assert qz.next_palettes("replace", [[1, 2], [3, 4]], stats, False) == [[0x090909, 77], [5, 6]]
    assert qz.next_palettes("color", [[1, 2], [3, 4]], stats, True) == [[1, 0x020000, 77], [3, 4, 3]]


def brute_dither(c, palette, x, y, pattern, weight):
    linear = [v * v for v in levels(c)]
    error, found = [0.0] * 3, []
    for _ in range(4 if pattern < 3 else 2):
        aim = [math.sqrt(min(max(v + e * weight, 0), 65025)) for v, e in zip(linear, error, strict=True)]
        d, i = min((sum(w * (a - b) ** 2 for w, a, b in zip((2, 4, 1), aim, levels(k), strict=True)), -i) for i, k in enumerate(palette))
        squares = [v * v for v in levels(palette[-i])]
        found.append((sum(s * v for s, v in zip((0.299, 0.587, 0.114), squares, strict=True)), -i, d))
        error = [e + v - s for e, v, s in zip(error, linear, squares, strict=True)]
    for a in range(len(found) - 1):
        for b in range(a + 1, len(found)):
            if found[a][0] > found[b][0]:
                found[a], found[b] = found[b], found[a]
    return found[model.DITHER_PATTERNS[pattern][x & 1][y & 1]][1:]


@pytest.mark.parametrize("pattern", [None, 0, 1, 2, 3, 4, 5])
def test_render(spark, pattern):
    rng = random.Random(8)
    tiles = image(rng, 9)
    palettes = [[rng.randrange(1 << 24) for _ in range(3)] for _ in range(2)]
    rows = [(1, p, i, *levels(c)) for p, x in enumerate(palettes) for i, c in enumerate(x)]
    dither = None if pattern is None else qz.Dither(pattern, 0.6)
    stored = spark.createDataFrame(rows, "image_id long, palette int, i int, r int, g int, b int")
    got = {r.cell: r for r in qz.render(blocks_of(spark, {1: tiles}), stored, dither).collect()}
    for t, pixels in enumerate(tiles):
        x0, y0 = t % 3 * 8, t // 3 * 8
        drawn = []
        for p in palettes:
            if pattern is None:
                drawn.append([None if c < 0 else (-nearest(p, c)[1], float(nearest(p, c)[0])) for c in pixels])
            else:
                drawn.append([None if c < 0 else brute_dither(c, p, x0 + k % 8, y0 + k // 8, pattern, 0.6) for k, c in enumerate(pixels)])
        totals = [sum(d[1] for d in x if d) for x in drawn]
        best = min(range(2), key=lambda p: totals[p])
        assert got[t].palette == best and got[t].error == pytest.approx(totals[best], rel=1e-12)
        assert got[t].indexes == [-1 if d is None else d[0] for d in drawn[best]]
        assert got[t].colors == [-1 if d is None else palettes[best][d[0]] for d in drawn[best]]


def test_finish_partial_is_the_whole_job_with_that_palette(spark):
    packed = blocks_of(spark, {1: image(random.Random(2), 12)})
    trained = qz.train(packed, 2, 4, 1, 1)
    stored = qz.listed(trained)
    dither = qz.Dither(0, 0.5)
    assert sorted(qz.finish_partial(packed, stored, dither, 4).collect()) == sorted(qz.render(packed, stored, dither, 4).collect())
    used = defaultdict(set)
    for r in qz.finish_partial(packed, stored, dither, 4).collect():
        used[r.palette] |= set(r.colors) - {-1}
    shown = {r.image_id: r for r in qz.table_of(stored, 4).collect()}[1]
    assert all(c in shown.palettes[p * 4 : p * 4 + 4] for p, colors in used.items() for c in colors)
    assert all(v % 17 == 0 for c in shown.palettes for v in levels(c))  # 4 bits a channel


def test_cut_tiles(spark):
    rng = random.Random(1)
    px = [(1, x, y, *levels(rng.randrange(1 << 24)), rng.choice([255, 255, 128, 0])) for x in range(11) for y in range(9)]
    sizes = spark.createDataFrame([(1, 11, 9)], "image_id long, width int, height int")
    pixels = spark.createDataFrame(px, "image_id long, x int, y int, r int, g int, b int, a int")
    got = {r.cell: r for r in qz.cut_tiles(pixels, sizes, 4, 4, "alpha").collect()}
    expected = defaultdict(lambda: [-1] * 16)
    for _, x, y, r, g, b, a in px:
        expected[y // 4 * 3 + x // 4][y % 4 * 4 + x % 4] = r << 16 | g << 8 | b if a == 255 else -1
    assert {c: r.pixels for c, r in got.items()} == dict(expected) and {r.tiles_x for r in got.values()} == {3}


def test_not_worse_than_batch_means(spark, sf_dir):
    """One palette: no more error than K-means from a fixed start with as many colours."""
    from tilefold.plans import queries as plans

    px = plans.pixels(spark, sf_dir)
    tiles = px.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("p", "r", "g", "b"))).alias("e")).select(F.lit(0).alias("image_id"), "cell", F.lit(20).alias("tiles_x"), F.transform("e", lambda x: F.shiftleft(x["r"], 16) + F.shiftleft(x["g"], 8) + x["b"]).alias("pixels"))
    error = qz.train(qz.blocks(tiles), 1, len(plans.PAL)).first().error
    batch = plans.quantize_batch(spark, sf_dir).join(plans.colors(spark, sf_dir), ["r", "g", "b"]).agg(F.sum(F.col("d") * F.col("n"))).first()[0]
    assert error <= batch


def test_whole_job(spark):
    rng = random.Random(12)
    colors = [(250, 10, 10), (20, 200, 30), (9, 9, 240), (120, 120, 120), (255, 255, 255)]
    px = [(i, x, y, *colors[min(4, int(rng.expovariate(0.9)))], 255 if (x + y) % 5 else 80) for i in (1, 2) for x in range(16) for y in range(16)]
    pixels = spark.createDataFrame(px, "image_id long, x int, y int, r int, g int, b int, a int")
    sizes = spark.createDataFrame([(1, 16, 16), (2, 16, 16)], "image_id long, width int, height int")
    modes = {r.image_id: r.zero for r in qz.opaque_mode(pixels).collect()}
    for i, zero in modes.items():
        opaque = [r << 16 | g << 8 | b for k, _, _, r, g, b, a in px if k == i and a == 255]
        assert opaque.count(zero) == max(map(opaque.count, set(opaque)))
    assert qz.opaque_mode(pixels.withColumn("a", F.lit(0))).select("zero").distinct().collect()[0][0] == 0
    out = qz.quantize(pixels, sizes, 2, 3, bits=4, shared=True, rounds=1)
    palettes = defaultdict(dict)
    for r in out["palettes"].collect():
        palettes[r.image_id][r.palette, r.i] = r.r << 16 | r.g << 8 | r.b
    reduced = lambda c: sum(int(v / 17 + 0.5) * 17 << s for v, s in zip(levels(c), (16, 8, 0), strict=True))
    assert all(palettes[i][p, 0] == reduced(modes[i]) for i in (1, 2) for p in (0, 1))
    source = {(i, x, y): reduced(r << 16 | g << 8 | b) for i, x, y, r, g, b, _ in px}
    for r in out["cells"].collect():
        table = [[palettes[r.image_id][p, k] for k in range(3)] for p in (0, 1)]
        seen = [source[r.image_id, r.cell % 2 * 8 + p % 8, r.cell // 2 * 8 + p // 8] for p in range(64)]
        errors = [sum(nearest(t, c)[0] for c in seen) for t in table]
        assert r.palette == errors.index(min(errors)) and r.colors == [table[r.palette][-nearest(table[r.palette], c)[1]] for c in seen]
    assert qz.quantize(pixels, sizes, 1, 3, bits=3, megadrive=True, dither=qz.Dither(4, 0.5), rounds=0)["cells"].count() == 8
