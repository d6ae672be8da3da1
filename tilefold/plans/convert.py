"""Conversion of images to console graphics: keys, palettes, tiles, attributes, diagnostics, files.

Many images are converted at once; every relation is keyed by ``image_id``. True-colour art is
packed into palettes; indexed art keeps its groups of four entries; the monochrome handheld has
one palette of shades for the whole image. Pixels reduce to distinct colours of a block before
anything is packed, and only the packing depends on scan order (``operators.palettes``). What several
later steps read is stored once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, tiles
from ..model import CONVERSION_NES, TARGETS, nes_candidates, rgb_table
from ..operators import tiles as tile_ops
from ..operators.palettes import first_fit
from ..working import stored, stored_bytes
from .editor import brightness_cuts
from .queries import hardware_color

TRANSPARENT = -1
DEFAULT_ZERO = 0x0F
#: Colours of the monochrome handheld.
SHADES = 4
#: Colours that are matched at once.
COLORS = 4096


@dataclass(frozen=True)
class Target:
    """``shared_zero``: all palettes share colour 0, which also stands for transparent pixels."""

    name: str
    block: int
    palettes: int
    colors: int
    tiles: int
    flips: bool

    @property
    def shared_zero(self) -> bool:
        return self.name == "nes"

    @property
    def shades(self) -> bool:
        return self.name == "gb"

    def key(self, r: Column, g: Column, b: Column, preferred: int | None = None) -> Column:
        if self.name == "nes":
            return hardware_color(r, g, b, preferred)
        if self.name == "gbc":
            return color.rgb555(r, g, b)
        return F.shiftleft(r, 16) + F.shiftleft(g, 8) + b

    def luma(self, key: Column) -> Column:
        if self.name == "nes":
            table = F.array(*[F.lit(299 * r + 587 * g + 114 * b) for r, g, b in rgb_table(CONVERSION_NES)])
            return F.get(table, key)
        if self.name == "gbc":
            parts = [color.expand5(F.shiftright(key, s).bitwiseAND(F.lit(31))) for s in (0, 5, 10)]
        else:
            parts = [F.shiftright(key, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0)]
        return color.luma(*parts)


def target(name: str, **custom) -> Target:
    """A console target, or ``generic`` with its own block, palettes, colors, tiles and flips."""
    return Target(name, **(custom or TARGETS[name]))


#: Parts that the rows of an image are dealt to where what is known of the image is not broadcast.
PARTS = 64


def by_image(rows: DataFrame, found: DataFrame, how: str, spread: str) -> DataFrame:
    """``rows`` joined with ``found`` (few rows an image) on the image, whose rows never gather in one task.

    A small ``found`` is broadcast; a larger one is copied to the parts that rows are dealt to by ``spread``.
    """
    found = stored(found)
    if stored_bytes(found) <= tile_ops.BROADCAST_BYTES:
        return rows.join(F.broadcast(found), "image_id", how)
    copies = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).hint("merge")
    return rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(PARTS)).cast("int")).join(copies, ["image_id", "_part"], how).drop("_part")


def _found(rows: DataFrame, code: str, n: Column | None = None) -> DataFrame:
    """A diagnostic of each image of ``rows`` (one row for each area)."""
    return rows.groupBy("image_id").agg(F.lit(code).alias("code"), (F.count("*") if n is None else n).alias("n"))


def nes_keys(preferred: int | None) -> Callable[..., Column]:
    """``hardware_color`` of arrays of channels. Each color of a batch is matched once."""
    order = np.array(nes_candidates(preferred), np.int32)
    table = np.array(rgb_table(CONVERSION_NES), np.int64)[order]

    @F.arrow_udf("array<int>")
    def keys(r: pa.Array, g: pa.Array, b: pa.Array) -> pa.Array:
        flat = [c.flatten() for c in (r, g, b)]
        missing = np.logical_or.reduce([np.asarray(c.is_null()) for c in flat])
        red, green, blue = (np.asarray(c.fill_null(0)).astype(np.int64) + (1 << 20) for c in flat)
        colors, place = np.unique(red << 42 | green << 21 | blue, return_inverse=True)
        found = np.empty(len(colors), np.int32)
        for s in range(0, len(colors), COLORS):
            part = np.stack([(colors[s : s + COLORS] >> shift & (1 << 21) - 1) - (1 << 20) for shift in (42, 21, 0)], axis=1)
            found[s : s + COLORS] = order[((part[:, None] - table) ** 2).sum(axis=2).argmin(axis=1)]
        ends = np.concatenate([[0], np.cumsum(np.asarray(r.value_lengths().fill_null(0)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found[place], pa.int32(), mask=missing))

    return keys


def keyed_pixels(pixels: DataFrame, sizes: DataFrame, to: Target, palette: DataFrame | None, shared: int | None) -> tuple[DataFrame, DataFrame]:
    """Pixels with their hardware colour, gathered by block and cell (image_id, block, cell, e: p, key and entry in the
    order of p), and diagnostics of images that are left out.

    Pixels of indexed images (with a ``palette``) have the colour of their entry, black where there is none.
    """
    w, h = F.col("width"), F.col("height")
    bad = sizes.where((w == 0) | (h == 0) | (w % 8 != 0) | (h % 8 != 0)).select("image_id", F.lit("dimensions").alias("code"), F.lit(1).cast("long").alias("n"))
    across = F.ceil(w / to.block).cast("int")
    block = F.floor(F.col("y") / to.block) * across + F.floor(F.col("x") / to.block)
    cell = F.floor(F.col("y") / 8) * F.floor(w / 8) + F.floor(F.col("x") / 8)
    p = (F.col("y") % 8 * 8 + F.col("x") % 8).cast("int")
    if "rgba" in pixels.columns and (palette is not None or to.block % 8):
        one = pixels.select("image_id", "x", "y", F.posexplode("rgba").alias("_p", "_c"))
        pixels = one.select("image_id", (F.col("x") + F.col("_p") % 8).alias("x"), (F.col("y") + F.floor(F.col("_p") / 8)).alias("y"), "_c.*")
    px = pixels.join(sizes, "image_id").join(bad.select("image_id"), "image_id", "left_anti")
    place = ["image_id", block.cast("long").alias("block"), cell.cast("long").alias("cell")]
    indexed, black = F.lit(False), F.lit(None).cast("int")
    if palette is not None and to.name != "generic":
        table = palette.select("image_id", "entry", to.key(F.col("r"), F.col("g"), F.col("b"), shared).cast("int").alias("entry_key"))
        images = table.select("image_id", F.lit(True).alias("indexed")).distinct()
        px = px.join(images, "image_id", "left").join(table, ["image_id", "entry"], "left")
        indexed, black = F.coalesce("indexed", F.lit(False)), to.key(F.lit(0), F.lit(0), F.lit(0), shared).cast("int")
        entry, entry_key = F.when(indexed, F.col("entry").cast("int")), F.col("entry_key")
    else:
        entry = entry_key = F.lit(None).cast("int")
    if "rgba" in px.columns:
        none = F.lit(None).cast("int")
        rows = px.select(*place, F.transform("rgba", lambda c, i: F.struct(i.alias("p"), *[c[n].cast("int").alias(n) for n in "rgba"], none.alias("entry"), none.alias("entry_key"), F.lit(False).alias("indexed"))).alias("c"))
    else:
        one = F.struct(p.alias("p"), *[F.col(n).cast("int").alias(n) for n in "rgba"], entry.alias("entry"), entry_key.alias("entry_key"), indexed.alias("indexed"))
        rows = px.select(*place, one.alias("one")).groupBy("image_id", "block", "cell").agg(F.array_sort(F.collect_list("one")).alias("c"))
    if to.name == "nes":
        keys = nes_keys(shared)(*[F.col(f"c.{n}") for n in "rgb"])
    else:
        keys = F.transform("c", lambda c: to.key(c["r"], c["g"], c["b"], shared).cast("int"))
    keyed = F.zip_with("c", "keys", lambda c, k: F.struct(c["p"].alias("p"), F.when(c["indexed"], F.coalesce(c["entry_key"], black)).when(c["a"] == 0, TRANSPARENT).otherwise(k).alias("key"), c["entry"].alias("entry")))
    partial = F.exists("c.a", lambda a: a.between(1, 254))
    rows = stored(rows.withColumn("keys", keys).select("image_id", "block", "cell", keyed.alias("e"), partial.alias("partial")))
    partial = _found(rows.where("partial").select("image_id", "cell").distinct(), "partial-alpha")
    partial = stored(partial)
    return by_image(rows.drop("partial"), partial.select("image_id"), "left_anti", "block"), bad.unionByName(partial)


def from_groups(px: DataFrame, palette: DataFrame, to: Target, shared: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Indexed art: the groups of four entries are the palettes. (values, palettes, diagnostics)."""
    group = F.shiftright("entry", 2)
    own = F.when(~(F.lit(to.shared_zero) & (F.col("entry") % 4 == 0)), group)  # the shared colour ties no block to a palette
    blocks = stored(px.groupBy("image_id", "block").agg(F.coalesce(F.min(own), F.lit(0)).alias("palette"), F.count_distinct(own).alias("groups"), F.max(own).alias("top"), F.max(group).alias("highest")))
    found = _found(blocks.where(F.col("top") >= to.palettes), "palette-count").unionByName(_found(blocks.where("groups > 1"), "region-palettes"))
    blocks = blocks.join(found.select("image_id").distinct(), "image_id", "left_anti")
    values = px.join(blocks.select("image_id", "block", "palette"), ["image_id", "block"]).select("image_id", "cell", "palette", "p", (F.col("entry") % 4).alias("v"))
    slots = blocks.groupBy("image_id").agg(F.max("highest").alias("highest")).select("image_id", F.explode(F.sequence(F.lit(0), F.col("highest") * 4 + 3)).alias("entry"))
    key = to.key(F.col("r"), F.col("g"), F.col("b"), shared).cast("int")
    table = slots.join(palette.select("image_id", "entry", key.alias("key")), ["image_id", "entry"], "left")
    table = table.select("image_id", F.floor(F.col("entry") / 4).cast("int").alias("palette"), (F.col("entry") % 4).cast("int").alias("idx"), F.col("key") if to.shades else F.coalesce("key", F.lit(0)).alias("key"))
    if to.shared_zero:
        zero = table.where("palette = 0 and idx = 0").select("image_id", (F.lit(shared) if shared is not None else F.col("key")).alias("zero"))
        table = table.join(zero, "image_id").withColumn("key", F.when(F.col("idx") == 0, F.col("zero")).otherwise(F.col("key"))).drop("zero")
    return values, table, found


def by_light(keys: Column, to: Target) -> Column:
    """Distinct keys: transparent first, then light to dark, then by key."""
    ordered = F.array_sort(F.transform(keys, lambda k: F.struct(F.when(k == TRANSPARENT, 0).otherwise(1).alias("t"), (-F.when(k == TRANSPARENT, 0).otherwise(to.luma(F.greatest(k, F.lit(0))))).alias("l"), k.alias("k"))))
    return F.transform(ordered, lambda s: s["k"])


def in_shades(px: DataFrame, to: Target, auto: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The monochrome handheld: one palette for the image. (values, palettes, diagnostics, how many colours were grouped).

    With ``auto``, images of more than four colours are grouped by brightness; a group's entry is the mean of its pixels.
    """
    counts = stored(px.where(F.col("key") != TRANSPARENT).groupBy("image_id", "key").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("image_id").agg(F.count("*").alias("colors"))
    many = sizes.where(F.col("colors") > SHADES)
    none = px.select("image_id").limit(0).withColumn("code", F.lit("image-colors")).withColumn("n", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "key"))
    if auto:
        found, grouped = none, many.select("image_id", F.col("colors").alias("auto_shaded"))
        binned = counts.join(many, "image_id").withColumn("bin", F.floor((to.luma(F.col("key")) + 500) / 1000).cast("int"))
        bins = stored(binned.groupBy("image_id", "bin").agg(F.sum("n").alias("w")))
        run = Window.partitionBy("image_id").orderBy("bin")  # at most 256 bins of an image
        sums = bins.select("image_id", "bin", F.row_number().over(run).cast("long").alias("i"), F.sum("w").over(run).alias("sw"), F.sum(F.col("w") * F.col("bin")).over(run).alias("s1"), F.sum(F.col("w") * F.col("bin") * F.col("bin")).over(run).alias("s2"))
        first = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("i", "sw", "s1", "s2")])
        cuts = sums.groupBy("image_id").agg(F.concat(F.array(first), F.array_sort(F.collect_list(F.struct("i", "sw", "s1", "s2")))).alias("z")).select("image_id", brightness_cuts(F.col("z")).alias("cuts"), F.least(F.lit(SHADES), F.size("z") - 1).alias("groups"))
        placed = sums.join(cuts, "image_id").select("image_id", "bin", "groups", (F.col("groups") - F.size(F.filter("cuts", lambda c: c < F.col("i")))).cast("int").alias("idx"))
        known = stored(binned.join(placed, ["image_id", "bin"]).select("image_id", "key", "n", "idx", "groups"))
        total = F.sum("n")
        mean = lambda s: F.floor((2 * F.sum(F.shiftright("key", s).bitwiseAND(F.lit(255)) * F.col("n")) + total) / (2 * total)).cast("int")
        rgb = F.shiftleft(mean(16), 16) + F.shiftleft(mean(8), 8) + mean(0)
        shade = F.when(F.first("groups") == 1, 0).otherwise(F.floor((6 * F.col("idx") + F.first("groups") - 1) / (2 * (F.first("groups") - 1)))).cast("int")
        means = known.groupBy("image_id", "idx").agg(rgb.alias("key"), shade.alias("shade")).select("image_id", "idx", "key", "shade")
        keys = known.select("image_id", "key", "idx")
    else:
        kept = counts.join(many.select("image_id"), "image_id", "left_semi").withColumn("rank", rank).where(F.col("rank") <= SHADES).select("image_id", "key")
        beyond = px.where(F.col("key") != TRANSPARENT).join(many.select("image_id"), "image_id", "left_semi").join(kept, ["image_id", "key"], "left_anti")
        found = _found(beyond.select("image_id", "block").distinct(), "image-colors").unionByName(none)
        grouped, keys, means = many.limit(0).select("image_id", F.col("colors").alias("auto_shaded")), None, None
    few = counts.join(many.select("image_id"), "image_id", "left_anti").groupBy("image_id").agg(by_light(F.collect_list("key"), to).alias("keys"))
    exact = few.select("image_id", F.posexplode("keys").alias("idx", "key"))
    table = exact.select("image_id", "idx", "key", F.lit(None).cast("int").alias("shade"))
    table = table.unionByName(means) if means is not None else table
    keys = exact.select("image_id", "key", "idx").unionByName(keys) if keys is not None else exact.select("image_id", "key", "idx")
    fine = px.join(found.select("image_id"), "image_id", "left_anti")
    values = fine.join(keys, ["image_id", "key"], "left").select("image_id", "cell", F.lit(0).alias("palette"), "p", F.coalesce("idx", F.lit(0)).alias("v"))
    slots = fine.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(SHADES - 1))).alias("idx"))
    palettes = slots.join(table, ["image_id", "idx"], "left").select("image_id", F.lit(0).alias("palette"), "idx", "key", "shade")
    return values, palettes, found, grouped


def in_palettes(px: DataFrame, to: Target, shared: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """True-colour art: the colour sets of blocks are packed into palettes. (values, palettes, diagnostics).

    Pixels stay gathered (image_id, block, cell, e), and so are the values (image_id, cell, palette, e: p and v).
    """
    capacity = to.colors
    rows = px.select("image_id", "block", "cell", F.col("e.p").alias("p"), F.col("e.key").alias("key"))
    if to.shared_zero:
        capacity -= 1
        totals = rows.select("image_id", F.explode("key").alias("key")).where(F.col("key") != TRANSPARENT).groupBy("image_id", "key").agg(F.count("*").alias("n"))
        zero = totals.groupBy("image_id").agg(F.max_by("key", F.struct("n", -F.col("key"))).alias("zero"))
        rows = by_image(rows, zero, "left", "block").withColumn("zero", F.lit(shared) if shared is not None else F.coalesce("zero", F.lit(DEFAULT_ZERO)))
        rows = stored(rows.withColumn("key", F.transform("key", lambda k: F.when(k == TRANSPARENT, F.col("zero")).otherwise(k))))
        shown, more = F.array_remove(F.array_compact(F.array_distinct("key")), F.col("zero")), [F.first("zero").alias("zero")]
    else:
        shown, more = F.array_compact(F.array_distinct("key")), []
    used = rows.withColumn("shown", shown).groupBy("image_id", "block").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("shown")))).alias("colors"), *more)
    used = stored(used)  # a block has at most as many colours as pixels
    over = stored(_found(used.where(F.size("colors") > capacity), "region-colors"))
    fitting = by_image(used, over.select("image_id"), "left_anti", "block")
    chosen = stored(first_fit(fitting.select("image_id", "block", "colors"), capacity).hint("merge").join(fitting, ["image_id", "block"]))
    many = chosen.groupBy("image_id").agg((F.max("palette") + 1).cast("long").alias("n")).where(F.col("n") > to.palettes).select("image_id", F.lit("palette-count").alias("code"), "n")
    many = stored(many)
    chosen = by_image(chosen, many.select("image_id"), "left_anti", "block")
    entries = chosen.groupBy("image_id", "palette").agg(F.array_distinct(F.flatten(F.collect_set("colors"))).alias("colors"), *([F.first("zero").alias("zero")] if to.shared_zero else []))
    keys = by_light(F.col("colors"), to)
    table = stored(entries.select("image_id", "palette", (F.concat(F.array("zero"), keys) if to.shared_zero else keys).alias("keys")))
    index = F.zip_with("p", "key", lambda p, k: F.struct(p.alias("p"), (F.array_position("keys", k) - 1).cast("int").alias("v")))
    # blocks take their palette's keys, so cells are only joined by block; blocks are never broadcast
    placed = tile_ops.looked_up(chosen.select("image_id", "block", "palette"), table, ["image_id", "palette"])
    values = rows.select("image_id", "block", "cell", "p", "key").join(placed.hint("merge"), ["image_id", "block"]).select("image_id", "cell", "palette", index.alias("e"))
    return values, table.select("image_id", "palette", F.posexplode("keys").alias("idx", "key")), over.unionByName(many)


def convert(pixels: DataFrame, sizes: DataFrame, to: Target, palette: DataFrame | None = None, auto_shades: bool = False, shared: int | None = None) -> dict[str, DataFrame]:
    """``pixels``: image_id, x, y, r, g, b, a; ``sizes``: image_id, width, height. Pixels may also come as whole cells of
    8x8 (image_id, x and y of the upper left one, ``rgba``: an array of 64 structs), which are then not gathered again.

    Indexed images have rows in ``palette`` (image_id, entry, r, g, b), and their pixels an ``entry``. ``shared``
    fixes the colour that all palettes share. ``auto_shades``: see ``in_shades``; indexed art beyond entry 3 is then
    converted from its colours.

    Returns ``diagnostics`` (image_id, code, n), and of images without any: ``palettes`` (image_id, palette, idx, key, and
    for the monochrome handheld the shade), ``cells`` (image_id, cell, tile, palette, flags), ``tiles`` (image_id, tile,
    pattern), and ``registers`` (image_id, bgp, auto_shaded) of the monochrome handheld. Diagnostics of a later stage
    are only given for images that passed the earlier ones.
    """
    gathered, found = keyed_pixels(pixels, sizes, to, palette, shared)
    px = gathered.select("image_id", "block", "cell", F.inline("e"))
    by_group = px.where("entry is not null")
    if to.shades and auto_shades:
        by_group = by_group.join(px.where("entry > 3").select("image_id").distinct(), "image_id", "left_anti")
    parts, tables, registers, cells = [], [], None, []
    if palette is not None and to.name != "generic":
        values, table, more = from_groups(by_group, palette, to, shared)
        parts, tables, found = [values], [table], found.unionByName(more)
        in_groups = by_group.select("image_id").distinct()
        px, gathered = (rows.join(in_groups, "image_id", "left_anti") for rows in (px, gathered))
    if to.shades:
        values, table, more, grouped = in_shades(px, to, auto_shades)
        tables = [t.withColumn("shade", F.lit(None).cast("int")) for t in tables]
        parts.append(values)
    else:
        values, table, more = in_palettes(gathered, to, shared)
        if to.block % 8:
            parts.append(values.select("image_id", "cell", "palette", F.inline("e")))
        else:  # a cell lies in one block
            cells.append(values.select("image_id", "cell", "palette", F.col("e.v").alias("tile")))
    for one in parts:
        cells.append(one.groupBy("image_id", "cell").agg(F.first("palette").alias("palette"), F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("tile")))
    for one in tables:
        table = table.unionByName(one)
    found = found.unionByName(more)
    if to.shades:
        table = stored(with_shades(table, to))
        byte = F.sum(F.when(F.col("idx") < SHADES, F.col("shade") * F.element_at(F.array(*[F.lit(1 << 2 * i) for i in range(SHADES)]), F.col("idx") + 1)))
        registers = table.where("palette = 0").groupBy("image_id").agg(byte.cast("int").alias("bgp")).join(grouped, "image_id", "left").select("image_id", "bgp", F.coalesce("auto_shaded", F.lit(0)).alias("auto_shaded"))
    cells = stored(functools.reduce(DataFrame.unionByName, cells))
    if to.flips:
        placed = tile_ops.with_flipped_ids(cells)
    else:
        placed = tile_ops.with_tile_ids(cells.withColumnRenamed("tile", "pattern"), key="pattern").withColumnRenamed("tile", "tile_id").withColumnRenamed("pattern", "tile").withColumn("flags", F.lit(0))
    placed = stored(placed)
    count = placed.groupBy("image_id").agg((F.max("tile_id") + 1).alias("n")).where(F.col("n") > to.tiles).select("image_id", F.lit("tile-count").alias("code"), "n")
    count = stored(count)
    fine = by_image(placed, count.select("image_id"), "left_anti", "cell")
    passed = fine.select("image_id").distinct()
    return {
        "diagnostics": found.unionByName(count),
        "palettes": table.join(passed, "image_id", "left_semi"),
        "cells": fine.select("image_id", "cell", F.col("tile_id").alias("tile"), "palette", "flags"),
        "tiles": fine.where("flags = 0").groupBy("image_id", F.col("tile_id").alias("tile")).agg(F.min_by("tile", "cell").alias("pattern")),
        **({"registers": registers.join(passed, "image_id", "left_semi")} if registers is not None else {}),
    }


def with_shades(table: DataFrame, to: Target) -> DataFrame:
    """Shades of palette entries that have none: spread over the distinct colours of the first palette by brightness, 3 for a missing entry."""
    distinct = table.where("palette = 0 and key is not null").groupBy("image_id").agg(by_light(F.collect_set("key"), to).alias("known"))
    place, n = F.array_position("known", F.col("key")) - 1, F.size("known")
    shade = F.when(F.col("key").isNull(), 3).when(n == 1, 0).otherwise(F.floor((6 * place + n - 1) / (2 * (n - 1)))).cast("int")
    grouped = F.max(F.col("shade").isNotNull()).over(Window.partitionBy("image_id"))  # four rows of a palette
    return table.withColumn("_auto", grouped).join(distinct, "image_id", "left").withColumn("shade", F.when(F.col("_auto"), F.coalesce("shade", F.lit(3))).otherwise(shade)).drop("known", "_auto")


def attribute_bytes(cells: DataFrame) -> DataFrame:
    """Cells with the colour handheld's attribute byte."""
    return cells.withColumn("byte", tiles.attribute_byte(F.col("palette"), (F.col("tile") > 255).cast("int"), F.col("flags").bitwiseAND(F.lit(1)), F.shiftright("flags", 1)).cast("int"))


def metatile_files(result: dict[str, DataFrame], sizes: DataFrame) -> DataFrame:
    """``metatiles`` and ``metamap`` as rows (image_id, file, data in hex) of images of whole 2x2 blocks.

    A metatile is the low bytes of its four tiles and their attribute bytes, as it is first seen; the map has a byte a
    block, or two, the lower one first, beyond 256 metatiles.
    """
    across = (F.col("width") / 8).cast("long")
    cells = stored(attribute_bytes(result["cells"]).join(sizes.select("image_id", across.alias("tiles_x")), "image_id"))
    blocks = stored(tile_ops.metatiles(cells.select("image_id", "cell", "tile", "palette", "flags", "tiles_x"), F.col("tiles_x")).select("image_id", "block", "metatile"))
    first = blocks.groupBy("image_id", "metatile").agg(F.min("block").alias("block"))
    x, y = F.col("cell") % F.col("tiles_x"), F.floor(F.col("cell") / F.col("tiles_x"))
    corner = cells.select("image_id", (F.floor(y / 2) * F.floor(F.col("tiles_x") / 2) + F.floor(x / 2)).alias("block"), (y % 2 * 2 + x % 2).alias("corner"), F.lpad(F.hex(F.col("tile") % 256), 2, "0").alias("low"), F.lpad(F.hex("byte"), 2, "0").alias("attribute"))
    quads = corner.join(first, ["image_id", "block"]).groupBy("image_id", "metatile").agg(F.array_sort(F.collect_list(F.struct("corner", "low", "attribute"))).alias("e"))
    bytes_ = F.concat(F.array_join(F.transform("e", lambda e: e["low"]), ""), F.array_join(F.transform("e", lambda e: e["attribute"]), ""))
    joined = lambda rows, order: rows.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "bytes"))), lambda s: s["bytes"]), "").alias("data"))
    defs = joined(quads.select("image_id", "metatile", bytes_.alias("bytes")), "metatile")
    wide = blocks.groupBy("image_id").agg((F.max("metatile") > 255).alias("wide"))
    id_ = F.col("metatile")
    word = F.concat(F.lpad(F.hex(id_ % 256), 2, "0"), F.when(F.col("wide"), F.lpad(F.hex(F.floor(id_ / 256)), 2, "0")).otherwise(""))
    map_ = joined(blocks.join(wide, "image_id").select("image_id", "block", word.alias("bytes")), "block")
    return defs.select("image_id", F.lit("metatiles").alias("file"), F.lower("data").alias("data")).unionByName(map_.select("image_id", F.lit("metamap").alias("file"), F.lower("data").alias("data")))


def files(result: dict[str, DataFrame], to: Target) -> DataFrame:
    """Hardware files as rows (image_id, file, data in hex): ``chr`` and ``pal``.

    NES tile data fills 4096 bytes and its palette file 16, with colour 0 where there is no entry;
    the colour handheld's palettes are little-endian 15-bit words, a generic target's RGB triplets, and
    the monochrome handheld's the byte of its register.
    """
    packed = tiles.pack_sequential if to.name == "nes" else lambda t: tiles.pack_paired(t, max(1, (to.colors - 1).bit_length()))
    parts = result["tiles"].select("image_id", "tile", tiles.hex_bytes(packed(F.col("pattern"))).alias("bytes"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "bytes"))), lambda s: s["bytes"]), "")
    chr_ = parts.groupBy("image_id").agg(text.alias("data"))
    if to.name == "nes":
        chr_ = chr_.withColumn("data", F.rpad("data", 8192, "0"))
    if to.shades:
        pal = result["registers"].select("image_id", F.lit("pal").alias("file"), F.lower(F.lpad(F.hex("bgp"), 2, "0")).alias("data"))
        return chr_.select("image_id", F.lit("chr").alias("file"), F.lower("data").alias("data")).unionByName(pal)
    zero = F.first("key").over(Window.partitionBy("image_id").orderBy("palette", "idx"))
    entry = result["palettes"].withColumn("zero", zero)
    key = F.col("key")
    if to.name == "gbc":
        low, high = F.greatest(key, F.lit(0)).bitwiseAND(F.lit(255)), F.shiftright(F.greatest(key, F.lit(0)), 8)
        value, blank = F.concat(F.lpad(F.hex(low), 2, "0"), F.lpad(F.hex(high), 2, "0")), F.lit("0000")
    elif to.name == "nes":
        value, blank = F.lpad(F.hex(key), 2, "0"), F.lpad(F.hex("zero"), 2, "0")
    else:
        value, blank = F.lpad(F.hex(F.greatest(key, F.lit(0))), 6, "0"), F.lit("000000")
    # every palette is filled up to its number of colours
    by_palette = entry.groupBy("image_id", "palette").agg(F.array_sort(F.collect_list(F.struct("idx", value.alias("value")))).alias("e"), F.first(blank).alias("blank"))
    full = F.concat(F.array_join(F.transform("e", lambda s: s["value"]), ""), F.array_join(F.array_repeat("blank", F.greatest(F.lit(0), F.lit(to.colors) - F.size("e"))), ""))
    pal = by_palette.select("image_id", "palette", full.alias("row"), "blank").groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("palette", "row"))), lambda s: s["row"]), "").alias("data"), F.first("blank").alias("blank"))
    if to.name == "nes":
        pal = pal.withColumn("data", F.concat("data", F.array_join(F.array_repeat("blank", F.greatest(F.lit(0), F.lit(16) - F.floor(F.length("data") / 2).cast("int"))), "")))
    return chr_.select("image_id", F.lit("chr").alias("file"), F.lower("data").alias("data")).unionByName(pal.select("image_id", F.lit("pal").alias("file"), F.lower("data").alias("data")))
