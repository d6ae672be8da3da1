"""Conversion of small images."""

from pyspark.sql import functions as F

from tilefold.plans.convert import convert, files, metatile_files, target


def image(spark, width, height, pixel, image_id=0):
    rows = []
    for y in range(height):
        for x in range(width):
            v = pixel(x, y)
            r, g, b, a = (0, 0, 0, 0) if v is None else v if len(v) == 4 else (*v, 255)
            rows.append((image_id, x, y, r, g, b, a))
    return spark.createDataFrame(rows or [(image_id, 0, 0, 0, 0, 0, 0)], "image_id int, x int, y int, r int, g int, b int, a int"), spark.createDataFrame([(image_id, width, height)], "image_id int, width int, height int")


def codes(spark, name, *args):
    return [(r.code, r.n) for r in convert(*image(spark, *args), target(name))["diagnostics"].collect()]


def test_diagnostics(spark):
    assert codes(spark, "gbc", 8, 4, lambda x, y: (0, 0, 0)) == [("dimensions", 1)]
    assert codes(spark, "gbc", 8, 8, lambda x, y: (0, 0, 0, 100)) == [("partial-alpha", 1)]
    assert codes(spark, "gbc", 16, 8, lambda x, y: (x % 8 * 32, 0, 0)) == [("region-colors", 2)]
    assert codes(spark, "gbc", 80, 8, lambda x, y: (x // 8 * 20, x % 4 * 60, 8)) == [("palette-count", 10)]
    assert codes(spark, "gbc", 8, 8, lambda x, y: (0, 0, 0)) == []


def test_mirrored(spark):
    shape = lambda x, y: (255, 255, 255) if x + 2 * y < 5 else (0, 0, 0)
    out = convert(*image(spark, 16, 16, lambda x, y: shape(min(x, 15 - x), min(y, 15 - y))), target("gbc"))
    assert [(r.tile, r.palette, r.flags) for r in out["cells"].orderBy("cell").collect()] == [(0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 0, 3)]
    data = {r.file: r.data for r in files(out, target("gbc")).collect()}
    assert len(data["chr"]) == 32 and data["pal"] == "ff7f" + "0000" * 3


def test_light_to_dark(spark):
    out = convert(*image(spark, 8, 8, lambda x, y: [(0, 0, 255), (255, 0, 0), (255, 255, 255), (0, 255, 0)][x % 4]), target("gbc"))
    assert [r.key for r in out["palettes"].orderBy("idx").collect()] == [0x7FFF, 0x03E0, 0x001F, 0x7C00]


def test_nes(spark):
    out = convert(*image(spark, 16, 16, lambda x, y: None if y == 0 else (0, 0, 0) if x < 12 else (255, 255, 255)), target("nes"))
    assert [(r.idx, r.key) for r in out["palettes"].orderBy("idx").collect()] == [(0, 0x0F), (1, 0x30)]
    data = {r.file: r.data for r in files(out, target("nes")).collect()}
    assert len(data["chr"]) == 8192 and data["pal"] == "0f300f0f" + "0f" * 12


def test_generic_transparent(spark):
    to = target("generic", block=8, palettes=4, colors=4, tiles=16, flips=False)
    out = convert(*image(spark, 8, 8, lambda x, y: None if x == 0 else (1, 2, 3)), to)
    assert [(r.idx, r.key) for r in out["palettes"].orderBy("idx").collect()] == [(0, -1), (1, 0x010203)]
    assert files(out, to).count() == 2


BLACK, WHITE, RED, GREEN, BLUE, GRAY = (0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128)


def indexed(spark, width, height, palette, entry, image_id=0):
    rows = [(image_id, x, y, *palette[entry(x, y)], 255, entry(x, y)) for y in range(height) for x in range(width)]
    pixels = spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int, a int, entry int")
    return pixels, spark.createDataFrame([(image_id, width, height)], "image_id int, width int, height int"), spark.createDataFrame([(image_id, i, *c) for i, c in enumerate(palette)], "image_id int, entry int, r int, g int, b int")


def shown(out):
    rows = sorted(out["palettes"].collect(), key=lambda r: (r.palette, r.idx))
    return [r.key for r in rows], [r.shade for r in rows] if "shade" in out["palettes"].columns else None


def strip(*draw):
    return 8 * len(draw), 8, lambda x, y: draw[x // 8](x % 8, y)


def test_monochrome(spark):
    to = target("gb")
    four = convert(*image(spark, *strip(lambda x, y: [BLACK, GRAY, (192, 192, 192), WHITE][x & 3])), to)
    assert [r.pattern[:4] for r in four["tiles"].collect()] == [[3, 2, 1, 0]] and four["registers"].first().bgp == 0xE4
    two = convert(*image(spark, *strip(lambda x, y: [BLACK, WHITE][x & 1])), to)
    assert shown(two)[1] == [0, 3, 3, 3] and two["registers"].first().bgp == 0xFC
    assert {r.file: r.data for r in files(two, to).collect()}["pal"] == "fc"
    # blue is the most used colour; of four equal others white has the highest key and is left over
    many = convert(*image(spark, *strip(lambda x, y: [BLACK, WHITE, RED, GREEN][x & 3], lambda x, y: BLUE)), to)
    assert [(r.code, r.n) for r in many["diagnostics"].collect()] == [("image-colors", 1)] and many["cells"].count() == 0


def test_auto_shades(spark):
    to = target("gb")
    grays = [(v, v, v) for v in (255, 238, 170, 153, 85, 68, 17, 0)]
    out = convert(*image(spark, *strip(lambda x, y: grays[x])), to, auto_shades=True)
    assert [r.pattern[:8] for r in out["tiles"].collect()] == [[0, 0, 1, 1, 2, 2, 3, 3]]
    assert tuple(out["registers"].first())[1:] == (0xE4, 8)
    assert shown(out) == ([0xF7F7F7, 0xA2A2A2, 0x4D4D4D, 0x090909], [0, 1, 2, 3])
    exact = convert(*image(spark, *strip(lambda x, y: grays[x % 4 * 2])), to, auto_shades=True)
    assert exact["registers"].first().auto_shaded == 0


def test_indexed(spark):
    palette = [BLACK, RED, RED, WHITE, BLUE, GREEN, GRAY, WHITE]
    out = convert(*(x := indexed(spark, 16, 8, palette, lambda x, y: (4 if x < 8 else 0) + (x & 3)))[:2], target("gbc"), x[2])
    assert [r.palette for r in out["cells"].orderBy("cell").collect()] == [1, 0]
    assert shown(out)[0] == [0x0000, 0x001F, 0x001F, 0x7FFF, 0x7C00, 0x03E0, 0x4210, 0x7FFF]
    assert [r.pattern[:8] for r in out["tiles"].collect()] == [[0, 1, 2, 3, 0, 1, 2, 3]]
    mixed = convert(*(x := indexed(spark, 8, 8, [BLACK, RED, GREEN, BLUE, WHITE, GRAY, RED, RED], lambda x, y: 5 if x == 0 else 1))[:2], target("gbc"), x[2])
    assert [(r.code, r.n) for r in mixed["diagnostics"].collect()] == [("region-palettes", 1)]


def test_indexed_monochrome(spark):
    six = [BLACK, WHITE, RED, GREEN, BLUE, GRAY]
    pixels, sizes, palette = indexed(spark, 8, 8, six, lambda x, y: x % 6)
    both = convert(pixels, sizes, target("gb"), palette)
    assert sorted(r.code for r in both["diagnostics"].collect()) == ["palette-count", "region-palettes"]
    fixed = convert(pixels, sizes, target("gb"), palette, auto_shades=True)
    assert fixed["registers"].first().auto_shaded == 6 and [r.pattern[:2] for r in fixed["tiles"].collect()] == [[3, 0]]
    pixels, sizes, palette = indexed(spark, 8, 8, [BLACK, WHITE, WHITE, GRAY], lambda x, y: x & 3)
    out = convert(pixels, sizes, target("gb"), palette)
    assert shown(out)[1] == [3, 0, 0, 2] and out["registers"].first().bgp == 3 | 2 << 6


def test_metatile_files(spark):
    base = lambda x, y: RED if x == 0 and y == 0 else GREEN if x == 1 else BLACK

    def draw(x, y):
        block = x // 16
        return BLACK if block == 3 else base(7 - x % 8, y % 8) if block == 1 and x % 16 >= 8 and y < 8 else base(x % 8, y % 8)

    pixels, sizes = image(spark, 64, 16, draw)
    data = {r.file: r.data for r in metatile_files(convert(pixels, sizes, target("gbc")), sizes).collect()}
    assert data["metamap"] == "00010002"
    assert data["metatiles"] == "00000000" + "00000000" + "00000000" + "00200000" + "01010101" + "00000000"


def test_shared_color(spark):
    art = image(spark, 16, 16, lambda x, y: (31, 158, 255) if y < 4 else BLACK)
    keys = lambda **o: shown(convert(*art, target("nes"), **o))[0]
    assert keys() == [0x0F, 0x21] and keys(shared=0x1D)[0] == 0x1D and keys(shared=0x30) == [0x30, 0x21, 0x0F]


def test_pixels_of_one_image_are_many_tasks(spark, monkeypatch):
    """What is known of an image reaches its rows without gathering them, small or large."""
    from tilefold.operators import tiles as tile_ops
    from tilefold.plans import convert as c

    rows = spark.range(0, 2000, 1, 4).select(F.lit(0).alias("image_id"), F.col("id").alias("block"))
    found = spark.createDataFrame([(0, 7), (1, 8)], "image_id int, n int")
    for limit in (tile_ops.BROADCAST_BYTES, 0):
        monkeypatch.setattr(tile_ops, "BROADCAST_BYTES", limit)
        joined = c.by_image(rows, found, "inner", "block")
        assert joined.count() == 2000 and joined.where("n <> 7").isEmpty()
        assert c.by_image(rows, found, "left_anti", "block").isEmpty()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            sizes = joined.select(F.spark_partition_id().alias("at")).distinct().count()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sizes > 1


def test_whole_cells(spark):
    """Cells convert as their pixels do, also where blocks cut cells; colors of arrays are matched as single ones are."""
    from tilefold.plans.convert import nes_keys
    from tilefold.plans.queries import hardware_color

    draw = lambda x, y: None if x == y else [BLACK, WHITE, RED, GREEN][(x * x // 3 + y // 8) % 2 + x // 32 * 2]
    pixels, sizes = image(spark, 64, 32, draw)
    order = F.array_sort(F.collect_list(F.struct((F.col("y") % 8 * 8 + F.col("x") % 8).alias("p"), "r", "g", "b", "a")))
    cells = pixels.groupBy("image_id", (F.floor(F.col("x") / 8) * 8).cast("int").alias("x"), (F.floor(F.col("y") / 8) * 8).cast("int").alias("y")).agg(F.transform(order, lambda c: c.dropFields("p")).alias("rgba"))
    for to in (target("nes"), target("gbc"), target("generic", block=4, palettes=4, colors=4, tiles=64, flips=False)):
        rows = [{k: sorted(map(str, v.collect())) for k, v in convert(p, sizes, to).items()} for p in (pixels, cells)]
        assert rows[0] == rows[1] and rows[0]["cells"]
    colors = spark.createDataFrame([(i, i * 37 % 256, i * 91 % 256, i * 53 % 256) for i in range(300)] + [(300, None, 1, 2)], "n int, r int, g int, b int")
    listed = colors.groupBy(F.floor(F.col("n") / 50)).agg(*[F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(c).alias("v")))), lambda s: s["v"]).alias(c) for c in ("n", "r", "g", "b")])
    for preferred in (None, 0x1D):
        found = listed.select(F.explode(F.arrays_zip("n", nes_keys(preferred)("r", "g", "b").alias("key"))).alias("s")).select("s.*")
        single = {r.n: r.key for r in colors.where("n < 300").select("n", hardware_color(F.col("r"), F.col("g"), F.col("b"), preferred).alias("key")).collect()}
        assert {r[0]: r[1] for r in found.collect()} == single | {300: None}
