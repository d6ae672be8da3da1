"""Tile compression against a plain scan in cell order, and first fit by its log of changes."""

import random

import pytest
from pyspark.sql import functions as F

from tilefold.operators import compression as cp
from tilefold.operators.palettes import first_fit

FLIPS = [(0, 0), (1, 0), (0, 1), (1, 1)]


def turned(tile, h, v, channels):
    return b"".join(tile[(p ^ (7 * h) ^ (56 * v)) * channels :][:channels] for p in range(64))


def scan(cells, target, tolerance, flips, channels):
    """Every cell in order: exact, mirrored, near; then the kept tiles and the nearest of them."""
    order = FLIPS if flips else FLIPS[:1]
    tiles, placed, joined = [], [], set()
    for _, pattern, marked in cells:
        hit = next(((tiles.index(t), f) for f, (h, v) in enumerate(order) for t in [turned(pattern, h, v, channels)] if t in tiles), None)
        if hit is None and tolerance > 0 and not marked:
            for t, other in enumerate(tiles):
                near = [f for f, (h, v) in enumerate(order) if sum(abs(a - b) for a, b in zip(pattern, turned(other, h, v, channels), strict=True)) <= tolerance * 64 * channels]
                if near:
                    hit = (t, near[0])
                    joined.add(pattern)
                    break
        if hit is None:
            tiles.append(pattern)
            hit = (len(tiles) - 1, 0)
        placed.append(hit)
    uses = [sum(t == i for t, _ in placed) for i in range(len(tiles))]
    kept_first = [any(t == i and c[2] for (t, _), c in zip(placed, cells, strict=True)) for i in range(len(tiles))]
    kept = list(range(len(tiles)))
    if len(tiles) > max(1, target):
        kept = sorted(kept, key=lambda t: (-kept_first[t], -uses[t], t))[: max(1, target)]
    out = []
    for (t, flags), (cell, pattern, _) in zip(placed, cells, strict=True):
        if t in kept:
            index, turn = kept.index(t), 0
        else:
            _, index, turn = min((sum((a - b) ** 2 for a, b in zip(tiles[t], turned(tiles[k], h, v, channels), strict=True)), i, f) for i, k in enumerate(kept) for f, (h, v) in enumerate(order))
        flags ^= turn
        drawn = turned(tiles[kept[index]], flags & 1, flags >> 1, channels)
        out.append((cell, index, flags, sum((a - b) ** 2 for a, b in zip(pattern, drawn, strict=True))))
    error = sum(e for *_, e in out)
    return out, (len(tiles) + len(joined), sum(kept_first), len(kept), sum(e > 0 for *_, e in out), error, error / (len(cells) * 64 * channels)), [tiles[k] for k in kept]


def art(rng, n, channels):
    """Variations of a few tiles: repeated, mirrored, a little or much changed, some marked."""
    base = [bytes(rng.randrange(256) for _ in range(64 * channels)) for _ in range(3)] + [bytes([200] * 64 * channels)]
    out = []
    for c in range(n):
        t = bytearray(turned(rng.choice(base), rng.randrange(2), rng.randrange(2), channels))
        for _ in range(rng.choice([0, 0, 1, 3, 40])):
            k = rng.randrange(len(t))
            t[k] = max(0, min(255, t[k] + rng.randrange(-90, 91)))
        out.append((c, bytes(t), rng.random() < 0.08))
    return out


def frame(spark, images):
    rows = [(i, c, t, m) for i, cells in images.items() for c, t, m in cells]
    return spark.createDataFrame(rows, "image_id long, cell long, pattern binary, marked boolean").repartition(4)


@pytest.mark.parametrize("target,tolerance,flips,channels", [(6, 0, True, 4), (5, 1.5, True, 4), (400, 2, False, 1)])
def test_against_scan(spark, monkeypatch, target, tolerance, flips, channels):
    monkeypatch.setattr(cp, "CHUNK", 12)  # many chunks, dealt to several shards
    rng = random.Random(target)
    images = {3: art(rng, 40, channels), 8: art(rng, 4, channels)}
    got = cp.compress(frame(spark, images), target, tolerance, flips, channels)
    cells, tiles = got["cells"].collect(), {(r.image_id, r.tile): bytes(r.pattern) for r in got["tiles"].collect()}
    summary = {r.image_id: tuple(r)[1:] for r in got["summary"].collect()}
    for i, art_ in images.items():
        out, facts, kept = scan(art_, target, tolerance, flips, channels)
        assert sorted((r.cell, r.tile, r.flags, r.error) for r in cells if r.image_id == i) == out
        assert summary[i] == facts
        assert [tiles[i, k] for k in range(len(kept))] == kept
    assert not got["cells"].where("flags is null or tile is null").count()


def test_long_chains(spark):
    """Each tile is near to its neighbours only, so each waits for the one before it."""
    cells = [(c, bytes([c * 3] * 64), False) for c in range(9)]
    rng = random.Random(1)
    shuffled = [(c, t, m) for c, (_, t, m) in enumerate(rng.sample(cells, len(cells)))]
    for order in (cells, shuffled):
        got = cp.merged(frame(spark, {1: order}), 3, channels=1)[0].orderBy("cell").collect()
        tiles, expected = [], []
        for _, t, _ in order:
            near = [i for i, x in enumerate(tiles) if abs(x[0] - t[0]) <= 3]
            tiles += [] if near else [t]
            expected.append(near[0] if near else len(tiles) - 1)
        assert [r.tile for r in got] == expected


def strip(spark, shades):
    return frame(spark, {0: [(c, bytes([s, s, s, 255]) * 64, m) for c, (s, m) in enumerate(shades)]})


def test_tolerance_joins_near_tiles_but_never_marked_cells(spark):
    # 100 and 104 differ by 4 a colour channel: a mean of 3 over four channels
    plain = [(100, False), (104, False), (200, False)]
    assert cp.compress(strip(spark, plain), 256, 2)["summary"].first().tiles == 3
    s = cp.compress(strip(spark, plain), 256, 3)
    assert tuple(s["summary"].first())[1:5] == (3, 0, 2, 1)
    assert s["summary"].first().mse == 16 * 3 * 64 / (3 * 64 * 4)
    assert {tuple(r.value) for r in cp.preview(s["cells"], s["tiles"], 3).where("x between 8 and 15").collect()} == {(100, 100, 100, 255)}
    assert cp.compress(strip(spark, [(100, False), (104, True), (200, False)]), 256, 3)["summary"].first().tiles == 3


def test_empty(spark):
    none = frame(spark, {1: [(0, bytes(64), False)]}).limit(0)
    assert all(x.count() == 0 for x in cp.compress(none, 4, 1, True, 1).values())


def test_first_fit_log(spark):
    """Random sets, repeated often, so that earlier palettes grow over sets that others held."""
    rng = random.Random(6)
    pools = [[rng.sample(range(9), rng.randrange(0, 4)) for _ in range(14)] for _ in range(5)]
    images = {i: [rng.choice(pool) for _ in range(120)] for i, pool in enumerate(pools)}
    images[9] = [[], [1, 2, 3, 4, 5, 6], [], [1]]
    rows = [(i, b * 3, s) for i, sets in images.items() for b, s in enumerate(sets)]
    out = first_fit(spark.createDataFrame(rows, "image_id int, block int, colors array<int>").repartition(3), 5)
    got = {(r.image_id, r.block): r.palette for r in out.collect()}
    assert len(got) == len(rows)
    for i, sets in images.items():
        palettes = []
        for b, s in enumerate(map(set, sets)):
            if len(s) > 5:
                expected = -1
            else:
                expected = next((p for p, x in enumerate(palettes) if s <= x), next((p for p, x in enumerate(palettes) if len(s | x) <= 5), len(palettes)))
                palettes[expected:] = [palettes[expected] | s, *palettes[expected + 1 :]] if expected < len(palettes) else [s]
            assert got[i, b * 3] == expected
    assert out.where(F.col("palette").isNull()).count() == 0


def test_cells_are_read_twice(spark):
    """Once for the patterns and once for their ids, however costly they are to make."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    cells = frame(spark, {1: art(random.Random(4), 30, 1)})
    got = cp.compress(cells.mapInArrow(counted, cells.schema), 4, 1, True, 1)
    assert got["cells"].count() == 30 and got["summary"].first().tiles == 4
    assert read.value <= 60


def test_noise_of_cells(spark, tmp_path):
    """Patterns that are made once for each place where the noise begins are those of every cell."""
    from tilefold.plans import queries as plans

    part = spark.createDataFrame([(i, abs(i) * 7 % 50 + 1) for i in [*range(-9, 0), *range(20), *range(395, 420)]], "p_partkey long, p_size int")
    part.write.parquet(f"{tmp_path}/part.parquet")
    rows = {r.cell: r.tile for r in plans.mosaic(spark, str(tmp_path)).select("cell", "tile").collect()}
    for noise in (1, 5):
        found = {(r.image_id, r.cell): bytes(r.pattern) for r in plans.rgba_cells(spark, str(tmp_path), noise).collect()}
        rest = lambda a: a % noise if a >= 0 else -(-a % noise)  # noqa: E731, B023
        expected = {}
        for c, tile in rows.items():
            rgba = [x for p, v in enumerate(tile) for x in (v * 85 - (rest(p * 5 + c * 3) if v else 0), 255 - v * 85, v * 17, 255)]
            expected[c // 400, c % 400 if c >= 0 else -(-c % 400)] = rgba
        ok = {k for k, v in expected.items() if max(v) < 256}
        assert found.keys() == expected.keys() and all(found[k] == bytes(expected[k]) for k in ok) and len(ok) >= 45
