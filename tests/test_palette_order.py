"""Palette sorting and seeded orders."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tilefold.functions import draws
from tilefold.operators import palette_order as po


def same_colors(a, b):
    return sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_no_exchange_helps():
    rng = np.random.default_rng(3)
    for n, fixed in ((5, 0), (6, 2), (1, 0)):
        d = rng.random((n, n))
        to = po.matched(d, fixed)
        assert sorted(to) == list(range(n)) and list(to[:fixed]) == list(range(fixed))
        total = d[np.arange(n), to].sum()
        for i, j in itertools.combinations(range(fixed, n), 2):
            other = to.copy()
            other[[i, j]] = other[[j, i]]
            assert d[np.arange(n), other].sum() >= total - 1e-6


def test_row_of_a_line():
    """Points of a line end up in its order, from either end; those that are fixed stay."""
    x = np.random.default_rng(1).permutation(9).astype(float)
    path = po.in_row(np.abs(x[:, None] - x))
    assert [x[i] for i in path] in ([*map(float, range(9))], [*map(float, range(8, -1, -1))])
    assert po.in_row(np.abs(x[:, None] - x), 2)[:2] == [0, 1]


def test_sorted_palettes(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (1, 6, 3))
    palettes = np.clip(base + rng.integers(-9, 10, (4, 6, 3)), 0, 255)
    mixed = np.array([p[np.append([0], 1 + rng.permutation(5))] for p in palettes])
    out = po.sort_palettes(mixed, 1)
    rows = {tuple(map(tuple, sorted(map(tuple, p)))) for p in mixed.tolist()}
    assert {tuple(map(tuple, sorted(map(tuple, p)))) for p in out.astype(int).tolist()} == rows
    assert po.unrest(out) < po.unrest(mixed.astype(float))
    firsts = sorted(tuple(p[0]) for p in mixed.tolist())
    assert sorted(tuple(p[0]) for p in out.astype(int).tolist()) == firsts  # colour 0 stays
    matched = np.abs(out[1:] - out[:-1]).max()
    assert matched <= 18  # variations of one colour stand below each other
    data = [(i, p, k, *map(int, c)) for i in (1, 2) for p, x in enumerate(mixed) for k, c in enumerate(x)]
    got = po.sorted_palettes(spark.createDataFrame(data, "image_id int, palette int, i int, r int, g int, b int"), 1).where("image_id = 2").orderBy("palette", "i").collect()
    assert [(r.r, r.g, r.b) for r in got] == [tuple(c) for p in out.astype(int).tolist() for c in p]


def test_permutation(spark):
    for bits in (2, 10, 12):
        rows = spark.range(1 << bits).select(draws.permuted(F.col("id"), 3, bits).alias("p"), draws.permuted(F.col("id"), 4, bits).alias("q")).collect()
        assert sorted(r.p for r in rows) == sorted(r.q for r in rows) == list(range(1 << bits))
        assert bits == 2 or [r.p for r in rows] != [r.q for r in rows]
    far = spark.range(1000).select(draws.permuted(F.col("id") * 1_000_003_000_000, 1, 60).alias("p")).distinct()
    assert far.count() == 1000
