"""Queries of the quantizer with several palettes, and of rendering from stored palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import bridge, model
from ..functions import draws
from ..operators import palette_order, quantizer
from .queries import _COL, _PAL_SQL, QUERIES, _dither_sql, _rounds_sql, query


def image_blocks(spark, d) -> DataFrame:
    """The colour tiles of all images in blocks."""
    rows = bridge.read(spark, d, "embeddings").select(F.col("label").cast("long").alias("image_id"), F.col("vec_id").alias("cell"), bridge.levels(F.col("embedding")).alias("lv"))

    def shifted(k: int):
        return F.concat(F.slice("lv", k + 1, 64 - k), F.slice("lv", 1, k))

    return quantizer.blocks(quantizer.tile_pixels(rows, shifted(0), shifted(21), shifted(42), bridge.TILES_X))


@query("quantize_tiles")
def quantize_tiles(spark, d):
    """Four palettes of four colours for every image, trained with the tiles that they draw."""
    trained = quantizer.train(image_blocks(spark, d), 4, 4)
    return quantizer.listed(trained).join(trained.select("image_id", "error", "pixels"), "image_id")


@query("render_dithered")
def render_dithered(spark, d):
    """Every tile dithered with the one of four stored palettes that gives the least dithered error."""
    palettes = spark.createDataFrame([(p, i, *c) for p, x in enumerate(model.PALETTES) for i, c in enumerate(x)], "palette int, i int, r int, g int, b int")
    packed = image_blocks(spark, d)
    table = packed.select("image_id").distinct().join(F.broadcast(palettes))  # sixteen rows for each image
    rows = quantizer.render(packed, table, quantizer.Dither(3, 0.5), bits=5)
    return rows.select("image_id", "cell", "palette", F.array_join(F.col("indexes").cast("array<string>"), "").alias("indexes"))


_FROM_PARTIAL = _dither_sql(model.DITHER_PATTERNS[0], 4, 0.5).removeprefix(f"with {_COL}, {_PAL_SQL}, ").replace("), pal)", "), p2)")


@query("finish_partial", f"{_rounds_sql(2)}, {_FROM_PARTIAL}")
def finish_partial(spark, d):
    """What a training stopped after two rounds gives: its stored palette, drawn with dithering."""
    saved = QUERIES["iterative_checkpoint"](spark, d).where("round = 1").select(F.lit(0).alias("palette"), "i", "r", "g", "b")
    packed = image_blocks(spark, d)
    table = packed.select("image_id").distinct().join(F.broadcast(saved))  # one palette for each image
    rows = quantizer.finish_partial(packed, table, quantizer.Dither(0, 0.5))
    return rows.select("cell", F.posexplode("indexes").alias("p", "i"))


_EPOCH_BITS = 40


@query("epoch_order", f"with p as ({draws.permuted_sql('(select vec_id as id from embeddings)', 7, _EPOCH_BITS)}) select id as cell, place from p")
def epoch_order(spark, d):
    """The key by which a training's epoch visits the tiles: a seeded permutation of their numbers, so no list is shuffled."""
    return bridge.read(spark, d, "embeddings").select(F.col("vec_id").alias("cell"), draws.permuted(F.col("vec_id"), 7, _EPOCH_BITS).alias("place"))


@query("sorted_palettes")
def sorted_palettes(spark, d):
    """For each image four palettes, the corner colours of its first tiles, in an order in which neighbours are alike."""
    px = bridge.tile_pixels(spark, d).where("p % 16 = 0")
    first = px.select("image_id", "cell").distinct().withColumn("palette", F.row_number().over(Window.partitionBy("image_id").orderBy("cell")) - 1).where("palette < 4")
    return palette_order.sorted_palettes(px.join(first, ["image_id", "cell"]).select("image_id", "palette", F.floor(F.col("p") / 16).cast("int").alias("i"), "r", "g", "b"))


@query("quantize_job")
def quantize_job(spark, d):
    """Reduced, trained, sorted and rendered: each image's tiles in two palettes of four colours whose first is the commonest opaque one."""
    px = bridge.tile_pixels(spark, d)
    x, y = F.col("cell") % bridge.TILES_X * 8 + F.col("p") % 8, F.floor(F.col("cell") / bridge.TILES_X) * 8 + F.floor(F.col("p") / 8)
    pixels_ = px.select("image_id", x.alias("x"), y.alias("y"), "r", "g", "b", F.when((F.col("r") + F.col("g")) % 4 == 0, 254).otherwise(255).alias("a"))
    sizes = px.groupBy("image_id").agg(F.lit(bridge.TILES_X * 8).alias("width"), ((F.floor(F.max("cell") / bridge.TILES_X) + 1) * 8).alias("height"))
    cells = quantizer.quantize(pixels_, sizes, 2, 4, bits=5, shared=True, rounds=2)["cells"]
    return cells.select("image_id", "cell", "palette", F.array_join(F.col("indexes").cast("array<string>"), "").alias("indexes"))
