"""Tile dictionaries: first-seen ids, mirrored tiles, top-k retention, metatiles.

Ids are given to distinct patterns, which are few beside the cells, after a partially
aggregated ``groupBy``; cells get them back by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import let
from ..functions.tiles import flipped
from ..working import stored, stored_bytes

#: Cell numbers that are ranked in one task.
STRETCH = 1 << 16
#: Files of a stored table up to this many bytes are broadcast; tiles compress well, so this is far below what a driver holds.
BROADCAST_BYTES = 1 << 18


def first_seen_ids(cells: DataFrame, key: str = "k", image: str = "image_id", cell: str = "cell") -> DataFrame:
    """(image, key) with ``tile`` (rank of its first cell, from 0), ``first_cell`` and ``uses``."""
    distinct = cells.groupBy(image, key).agg(F.min(cell).alias("first_cell"), F.count("*").alias("uses"))
    return numbered(distinct, "first_cell", "tile", image)


def numbered(rows: DataFrame, order: str, name: str, image: str = "image_id") -> DataFrame:
    """``rows`` with their rank in the image (from 0) by ``order``, a whole number that no two rows of an image share.

    Rows are ranked within stretches of ``STRETCH`` numbers, so one large image is many tasks' work; only
    the sizes of the stretches, one row for each, are summed up image by image.
    """
    placed = rows.withColumn("_stretch", F.floor(F.col(order) / STRETCH))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(image).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy(image, "_stretch").agg(F.count("*").alias("_n")).select(image, "_stretch", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy(image, "_stretch").orderBy(order)) - 1
    return placed.withColumn("_rank", rank).join(offsets, [image, "_stretch"]).withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_stretch", "_rank", "_before")


def with_tile_ids(cells: DataFrame, key: str = "k", image: str = "image_id", cell: str = "cell") -> DataFrame:
    """Cells with their tile id and flag bits 0."""
    return cells.join(first_seen_ids(cells, key, image, cell).select(image, key, "tile"), [image, key])


def canonical(tile: Column) -> Column:
    """The least of a tile's four mirror images (arrays compare element by element)."""
    return let(tile, lambda t: F.array_min(F.array(t, flipped(t, True, False), flipped(t, False, True), flipped(t, True, True))))


def with_flipped_ids(cells: DataFrame, tile: str = "tile", image: str = "image_id", cell: str = "cell") -> DataFrame:
    """Cells with ``tile_id`` shared by mirror images, and ``flags`` (1 horizontal, 2 vertical) that turn
    the stored tile, the first one seen, into the cell's; of several the least flags.

    Mirror images are made of distinct tiles only, and cells meet these by a merge join: the size that the planner
    assumes for tiles made of narrow rows is far too small for a broadcast of cells.
    """
    patterns = cells.groupBy(image, F.col(tile).alias("_tile")).agg(F.min(cell).alias("_first")).withColumn("canon", canonical(F.col("_tile")))
    patterns = stored(patterns)
    distinct = patterns.groupBy(image, "canon").agg(F.min_by("_tile", "_first").alias("stored"), F.min("_first").alias("first_cell"))
    ranked = stored(numbered(distinct, "first_cell", "tile_id", image).drop("first_cell"))
    flags = F.when(F.col("_tile") == F.col("stored"), 0)
    for value, (h, v) in ((1, (True, False)), (2, (False, True)), (3, (True, True))):
        flags = flags.when(flipped(F.col("_tile"), h, v) == F.col("stored"), value)
    placed = stored(patterns.join(ranked, [image, "canon"]).select(image, F.col("_tile").alias(tile), "tile_id", flags.alias("flags")))
    return looked_up(cells, placed, [image, tile])


def looked_up(cells: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``cells`` with the columns of ``found`` (a stored table, one row for each key).

    Only ``found`` is ever broadcast, and only if its files are small; else the join merges, and may split hot keys.
    """
    return cells.join(F.broadcast(found) if stored_bytes(found) <= BROADCAST_BYTES else found.hint("merge"), keys)


def retained(tiles: DataFrame, k: int, image: str = "image_id") -> DataFrame:
    """The k tiles to keep: marked first, then most used, then first seen."""
    rank = F.row_number().over(Window.partitionBy(image).orderBy(F.desc("marked"), F.desc("uses"), "tile"))
    return tiles.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def metatiles(cells: DataFrame, tiles_x: int | Column, image: str = "image_id") -> DataFrame:
    """Blocks of 2x2 cells with first-seen ids: (image, block, metatile). ``cells``: image, cell, tile, and palette and flags where it has them.

    Blocks are equal if their tiles, palettes and flags are. An image of an odd number of columns or rows has none.
    ``tiles_x`` may be a column of the cells.
    """
    parts = ["tile", *(c for c in ("palette", "flags") if c in cells.columns)]
    across = F.lit(tiles_x) if isinstance(tiles_x, int) else tiles_x
    cells = cells.withColumn("_x", across.cast("long"))
    col, row = F.col("cell") % F.col("_x"), F.floor(F.col("cell") / F.col("_x"))
    whole = cells.groupBy(image).agg(F.max(row).alias("last"), F.max("_x").alias("_x")).where((F.col("last") % 2 == 1) & (F.col("_x") % 2 == 0)).select(image)
    part = F.concat_ws(":", *parts)
    placed = cells.join(whole, image, "left_semi").select(image, part.alias("part"), (F.floor(row / 2) * F.floor(F.col("_x") / 2) + F.floor(col / 2)).alias("block"), ((row % 2) * 2 + col % 2).alias("corner"))
    quads = placed.groupBy(image, "block").agg(*[F.max(F.when(F.col("corner") == i, F.col("part"))).alias(f"q{i}") for i in range(4)])
    quads = quads.withColumn("k", F.concat_ws("-", *[F.col(f"q{i}") for i in range(4)]))
    return with_tile_ids(quads, cell="block", image=image).withColumnRenamed("tile", "metatile")
