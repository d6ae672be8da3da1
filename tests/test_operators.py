"""Small images with known results."""

import random

from pyspark.sql import functions as F

from tilefold import bridge, model
from tilefold.functions import color, tiles
from tilefold.operators import compression, streams, tiles as tile_ops
from tilefold.operators.palettes import first_fit
from tilefold.plans import queries as plans


def test_channel_reduction(spark):
    rows = spark.createDataFrame([(255, 130, 0)], "r int, g int, b int")
    four = rows.select(*[color.reduce_channel(F.col(c), 4).cast("int") for c in "rgb"]).first()
    mega = rows.select(*[color.reduce_channel(F.col(c), 4, True).cast("int") for c in "rgb"]).first()
    assert tuple(four) == (255, 136, 0) and tuple(mega) == (238, 136, 0)


def test_rounding(spark):
    rows = spark.createDataFrame([(-2.5,), (2.5,), (300.0,), (float("nan"),)], "x double")
    assert [r[0] for r in rows.select(color.half_up(F.col("x"))).limit(2).collect()] == [-2, 3]
    assert [r[0] for r in rows.select(color.clamp_byte(F.col("x"))).collect()] == [0, 2, 255, 0]


def test_nearest_ties(spark):
    palette = color.literal_colors([(10, 0, 0), (10, 0, 0), (0, 0, 0)])
    rows = spark.createDataFrame([(10, 0, 0)], "r int, g int, b int")
    c = [F.col(x) for x in "rgb"]
    assert rows.select(color.nearest(*c, palette)["i"]).first()[0] == 1
    assert rows.select(color.nearest(*c, palette, highest_wins=False)["i"]).first()[0] == 0


def test_quantizer_nes(spark):
    nes = model.rgb_table(model.QUANTIZER_NES)
    rows = spark.createDataFrame([(0x50, 0xA0, 0xF8), (10, 5, 8), (250, 250, 250)], "r int, g int, b int")
    found = rows.select(color.nearest(*[F.col(x) for x in "rgb"], color.literal_colors(nes))["i"].alias("i")).collect()
    assert [nes[r.i] for r in found] == [(74, 159, 255), (0, 0, 0), (255, 255, 255)]


def test_hardware_black_and_white(spark):
    rows = spark.createDataFrame([(0, 0, 0), (255, 255, 255)], "r int, g int, b int")
    assert [r[0] for r in rows.select(plans.hardware_color(*[F.col(x) for x in "rgb"])).collect()] == [0x0F, 0x30]


def test_packing(spark):
    tile = [x & 3 for _ in range(7) for x in range(8)] + [3] * 8
    rows = spark.createDataFrame([(tile,)], "tile array<int>")
    assert rows.select(tiles.hex_bytes(tiles.pack_sequential(F.col("tile")))).first()[0] == "55" * 7 + "ff" + "33" * 7 + "ff"
    assert rows.select(tiles.hex_bytes(tiles.pack_paired(F.col("tile"), 2))).first()[0] == "5533" * 7 + "ffff"
    assert rows.select(F.size(tiles.pack_paired(F.col("tile"), 3))).first()[0] == 24


def test_rgb555(spark):
    rows = spark.createDataFrame([(255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255)], "r int, g int, b int")
    assert [r[0] for r in rows.select(color.rgb555(*[F.col(x) for x in "rgb"])).collect()] == [0x7FFF, 0x1F, 0x3E0, 0x7C00]


def test_mirrored_tiles(spark):
    tile = list(range(64))
    images = [tile, *[[tile[p ^ m] for p in range(64)] for m in (7, 56, 63)]]
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(images)], "image_id int, cell int, tile array<int>")
    out = tile_ops.with_flipped_ids(rows).orderBy("cell").collect()
    assert [(r.tile_id, r.flags) for r in out] == [(0, 0), (0, 1), (0, 2), (0, 3)]


def test_first_fit(spark):
    sets = [[1, 2, 3], [2, 3], [1, 4], [5, 6], [5, 7], [1, 2, 3, 4, 5]]
    rows = spark.createDataFrame([(0, i, s) for i, s in enumerate(sets)], "image_id int, block int, colors array<int>")
    assert [r.palette for r in first_fit(rows, 4).orderBy("block").collect()] == [0, 0, 0, 1, 1, -1]


def fit_in_order(sets, capacity):
    """First-fit block by block."""
    palettes, chosen = [], []
    for s in map(set, sets):
        if len(s) > capacity:
            chosen.append(-1)
            continue
        at = next((i for i, p in enumerate(palettes) if s <= p), None)
        if at is None:
            at = next((i for i, p in enumerate(palettes) if len(s | p) <= capacity), len(palettes))
        if at == len(palettes):
            palettes.append(set())
        palettes[at] |= s
        chosen.append(at)
    return chosen


def test_first_fit_by_brute_force(spark):
    """Repeated, empty and oversized sets; sets that an earlier palette grows to hold; several images."""
    rng = random.Random(4)
    images = [[rng.sample(range(9), rng.choice([0, 1, 2, 2, 3, 3, 4, 5])) for _ in range(120)] for _ in range(6)]
    images += [[[1, 2], [3, 4, 5], [2, 3], [4], [2, 3]], [[]], [[1, 2, 3, 4, 5]]]
    rows = [(i, b, s) for i, sets in enumerate(images) for b, s in enumerate(sets)]
    out = first_fit(spark.createDataFrame(rows, "image_id int, block int, colors array<int>"), 4)
    got = {(r.image_id, r.block): r.palette for r in out.collect()}
    assert got == {(i, b): c for i, sets in enumerate(images) for b, c in enumerate(fit_in_order(sets, 4))}
    assert first_fit(out.limit(0).select("image_id", "block", F.array("palette").alias("colors")), 4).count() == 0


def test_tolerance(spark):
    flat = [[v] * 64 for v in (0, 2, 5, 0)]
    rows = spark.createDataFrame([(0, i, bytes(t), False) for i, t in enumerate(flat)], "image_id int, cell long, pattern binary, marked boolean")
    assert [r.tile for r in compression.merged(rows, 2, channels=1)[0].orderBy("cell").collect()] == [0, 0, 1, 0]
    kept = rows.withColumn("marked", F.col("cell") == 1)
    assert [r.tile for r in compression.merged(kept, 2, channels=1)[0].orderBy("cell").collect()] == [0, 1, 2, 0]


def test_metatiles_by_palette_and_flags(spark):
    """Three blocks of equal tiles, of which one has a flipped cell and one another palette; odd sizes have none."""
    rows = [(0, y * 6 + x, 5, int(x == 4 and y == 0), int(x == 3 and y == 0)) for y in range(2) for x in range(6)]
    cells = spark.createDataFrame(rows, "image_id int, cell int, tile int, palette int, flags int")
    assert [r.metatile for r in tile_ops.metatiles(cells, 6).orderBy("block").collect()] == [0, 1, 2]
    assert tile_ops.metatiles(cells, 3).count() == 0 and tile_ops.metatiles(cells.where("cell < 6"), 6).count() == 0


def test_metatiles(spark):
    cells = [(0, c, t) for c, t in enumerate([1, 1, 2, 2, 1, 1, 3, 3, 1, 1, 2, 2, 1, 1, 3, 3])]
    rows = spark.createDataFrame(cells, "image_id int, cell int, tile long")
    assert [r.metatile for r in tile_ops.metatiles(rows, 8).orderBy("block").collect()] == [0, 1, 0, 2]


def bytes_of(spark, data):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(data)], "stream string, i int, v int")


def test_packets(spark):
    small = bytes([4, 4, 0, 1, 2, 3, 3, 3, 6, 6, 6, 6, 1])
    for distance, expected in ((1, "430400010203770601"), (2, "010404000102030337060601")):
        rows = streams.packets(bytes_of(spark, small), distance).orderBy("packet").collect()
        assert "".join(f"{r.control:02x}{r.literals}" for r in rows) == expected


def test_dither(spark):
    px = spark.createDataFrame([(0, p, 120, 120, 120) for p in (0, 1, 8, 9)], "cell int, p int, r int, g int, b int")
    out = plans.dithered(px, [(0, 0, 0), (255, 255, 255)], model.DITHER_PATTERNS[0], 4, 1.0)
    assert {r.i for r in out.collect()} == {0, 1}


def test_layer_flatten_covers_the_map(spark, tmp_path):
    """Cells of any id, against brute force."""
    orders = [(k, k * 37 % 9000) for k in (0, 7, 1999, 2000, 2001, 2006, 70_005, 149_998, 149_999)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i,) for i in range(60)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    expected = set()
    for cell, cust in orders:
        gid, bits = cust % 1500 + 1, cell % 8
        lid = gid - max(f for f in (i * 20 + 1 for i in range(60)) if f <= gid)
        for p in range(64):
            x, y = 7 - p % 8 if bits & 4 else p % 8, 7 - p // 8 if bits & 2 else p // 8
            x, y = (y, x) if bits & 1 else (x, y)
            expected.add((cell, p, (lid * 7 + y * 8 + x) % 128))
    got = [tuple(r) for r in plans.QUERIES["layer_flatten_whole"](spark, str(tmp_path)).select("cell", "p", "idx").collect()]
    assert len(got) == 64 * len(orders) and set(got) == expected


def test_ids_do_not_depend_on_stretches(spark, monkeypatch):
    rows = [(image, cell, str((cell * 7 + image) % 13)) for image in (0, 1) for cell in (0, 2, 3, 9, 10, 11, 25, 26, 40, 1000)]
    df = spark.createDataFrame(rows, "image_id int, cell long, k string")
    expected = {}
    for image, _, k in sorted(rows):
        seen = [key for i, key in expected if i == image]
        expected.setdefault((image, k), len(seen))
    for stretch in (1, 3, 1 << 16):
        monkeypatch.setattr(tile_ops, "STRETCH", stretch)
        assert {(r.image_id, r.k): r.tile for r in tile_ops.first_seen_ids(df).collect()} == expected


def test_mosaic_of_any_cell(spark, tmp_path):
    """Tiles by remainders are those of the formula, and a small file is many tasks' work."""
    parts = [(c, s) for c in [*range(0, 400, 7), 97 * 61 * 4 + 3] for s in (0, 1, 17, 30, 50)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for rich in (False, True):
        rows = bridge.mosaic_tiles(spark, str(tmp_path), rich, k=bridge.pattern_key)
        for r in rows.collect():
            s = r.p_size + 50 * (r.cell % 97) if rich else r.p_size
            want = []
            for p in range(64):
                x, y = 7 - p % 8 if r.cell % 4 in (1, 3) else p % 8, 7 - p // 8 if r.cell % 4 >= 2 else p // 8
                v = (s % 3 + x * (s % 2 + 1) + y * (s % 5)) % 4
                want.append((v + 1) % 4 if rich and p == r.cell % 61 else v)
            assert r.tile == want and r.k == "".join(map(str, want))
        assert rows.count() == len(parts) and rows.rdd.getNumPartitions() >= 4


def test_cells_are_never_broadcast(spark, sf_dir):
    """The planner takes cells with tiles for small; only tables that are stored, and known to be small, may be broadcast."""
    cells = bridge.mosaic_tiles(spark, sf_dir).withColumn("image_id", F.lit(0))
    plan = tile_ops.with_flipped_ids(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "rightHint" in plan
    before = tile_ops.BROADCAST_BYTES
    try:
        tile_ops.BROADCAST_BYTES = 0
        joined = tile_ops.with_flipped_ids(cells)
        assert "strategy=merge" in joined._jdf.queryExecution().optimizedPlan().toString()
        assert joined.count() == cells.count()
    finally:
        tile_ops.BROADCAST_BYTES = before
