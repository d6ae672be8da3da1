"""Several palettes for an image, each tile drawn with one of them: training and rendering.

Tiles are packed into blocks of some hundred, so an image of any size is many tasks' work. A pass
gives every tile its best palette and every pixel its best colour in it, and sums up for each
colour and palette what the next step needs: pixel sums, errors, what its removal would cost, and
where the error is largest. The sums of an image (at most palettes x colours rows) decide its next
palettes; images are independent, and nothing is collected.

Training follows the order of the stochastic quantizer, in batches instead of single pixels: one
colour, then one palette more a pass (taken from the worst tile of the palette of the largest
error), then one colour more in every palette a pass (the pixel farthest from the colour of the
largest error), then rounds that replace the colour and the palette whose removal costs least
where that is less than half of the largest error, then rounds of means. The best palettes met
with the full number of colours are the result. Colours are whole levels and sums whole numbers, so
the result does not depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import color
from ..working import release, stored
from .palette_order import sorted_palettes

#: Tiles of one block.
BLOCK_TILES = 256
#: Palette rows that are broadcast; more are joined by image.
BROADCAST_COLORS = 1 << 20
WEIGHTS = np.array([2, 4, 1], np.int64)
REPLACE = 0.5
_BRIGHT = np.array([0.299, 0.587, 0.114])


def cut_tiles(pixels: DataFrame, sizes: DataFrame, tile_width: int = 8, tile_height: int = 8, transparent: str | None = None, zero: int | None = None) -> DataFrame:
    """Tiles (image_id, cell, tiles_x, pixels) of images (image_id, x, y, r, g, b, a; image_id, width, height).

    ``pixels`` holds packed colours row by row, -1 outside the image and where the pixel is
    transparent: by alpha below 255 (``transparent`` = "alpha") or by the colour ``zero`` ("color").
    """
    across = F.ceil(F.col("width") / tile_width).cast("long")
    rgb = F.shiftleft("r", 16) + F.shiftleft("g", 8) + F.col("b")
    seen = F.lit(True) if transparent is None else F.col("a") == 255 if transparent == "alpha" else rgb != F.lit(zero)
    spot = (F.col("y") % tile_height * tile_width + F.col("x") % tile_width).cast("int")
    rows = pixels.join(sizes, "image_id").select("image_id", (F.floor(F.col("y") / tile_height) * across + F.floor(F.col("x") / tile_width)).alias("cell"), across.alias("tiles_x"), F.struct(spot.alias("p"), F.when(seen, rgb).otherwise(-1).cast("int").alias("v")).alias("s"))
    found = rows.groupBy("image_id", "cell", "tiles_x").agg(F.map_from_entries(F.collect_list("s")).alias("m"))  # as long as a tile
    full = F.transform(F.sequence(F.lit(0), F.lit(tile_width * tile_height - 1)), lambda p: F.coalesce(F.element_at("m", p), F.lit(-1)))
    return found.select("image_id", "cell", "tiles_x", full.alias("pixels"))


def opaque_mode(pixels: DataFrame) -> DataFrame:
    """(image_id, zero): the commonest colour of an image's opaque pixels (image_id, x, y, r, g, b, a), of equals the first to be complete; black without any."""
    rgb = (F.shiftleft("r", 16) + F.shiftleft("g", 8) + F.col("b")).cast("int")
    counts = pixels.where("a = 255").groupBy("image_id", rgb.alias("rgb")).agg(F.count("*").alias("n"), F.max(F.struct("y", "x")).alias("last"))
    best = counts.groupBy("image_id").agg(F.max_by("rgb", F.struct("n", (-F.col("last.y")).alias("y"), (-F.col("last.x")).alias("x"))).alias("zero"))
    return pixels.select("image_id").distinct().join(best, "image_id", "left").select("image_id", F.coalesce("zero", F.lit(0)).alias("zero"))


def reduced_rgb(rgb: Column, bits: int, megadrive: bool = False) -> Column:
    """A packed colour in ``bits`` a channel; -1 stays."""
    parts = [color.reduce_channel(F.shiftright(rgb, s).bitwiseAND(F.lit(255)).cast("double"), bits, megadrive).cast("int") for s in (16, 8, 0)]
    return F.when(rgb < 0, rgb).otherwise(F.shiftleft(parts[0], 16) + F.shiftleft(parts[1], 8) + parts[2])


def reduced_tiles(tiles: DataFrame, bits: int, megadrive: bool = False) -> DataFrame:
    """Tiles whose pixels are reduced before training, as it is done where nothing is dithered."""
    return tiles.withColumn("pixels", F.transform("pixels", lambda c: reduced_rgb(c, bits, megadrive)))


def blocks(tiles: DataFrame) -> DataFrame:
    """Tiles (image_id, cell, tiles_x, pixels) in blocks, stored: the passes read them again and again."""
    grouped = tiles.groupBy("image_id", "tiles_x", F.floor(F.col("cell") / BLOCK_TILES).alias("block"))
    return stored(grouped.agg(F.collect_list(F.struct(F.col("cell").cast("long").alias("cell"), F.col("pixels").cast("array<int>").alias("pixels"))).alias("tiles")))


def with_palettes(rows: DataFrame, palettes: DataFrame, size: int) -> DataFrame:
    """Blocks beside the palettes of their image; small palette tables are broadcast."""
    small = palettes.count() * size <= BROADCAST_COLORS
    return rows.join(F.broadcast(palettes) if small else palettes, "image_id")


@dataclass
class Tiles:
    """The pixels of a block: ``rgb`` of those that are seen, the tile of each, and its place in the tile."""

    cells: np.ndarray
    rgb: np.ndarray
    tile: np.ndarray
    place: np.ndarray
    width: int

    @classmethod
    def of(cls, column: pa.ListScalar) -> Tiles:
        values = column.values
        cells, lists = np.asarray(values.field("cell")), values.field("pixels")
        order = np.argsort(cells, kind="stable")
        packed = np.asarray(lists.flatten()).reshape(len(cells), -1)[order]
        tile, place = np.nonzero(packed >= 0)
        return cls(cells[order], packed[tile, place], tile, place, packed.shape[1])

    def levels(self) -> np.ndarray:
        return unpacked(self.rgb)

    def per_tile(self, values: np.ndarray) -> np.ndarray:
        """Sums of whole numbers over each tile."""
        return np.bincount(self.tile, weights=values, minlength=len(self.cells)).astype(np.int64)


def unpacked(rgb: np.ndarray) -> np.ndarray:
    rgb = np.asarray(rgb, np.int64)
    return np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], axis=-1)


def distances(levels: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Weighted squared distances of pixels to the colours of a palette (whole numbers)."""
    a, c = levels.astype(np.float64), palette.astype(np.float64)
    return ((a * a * WEIGHTS).sum(1)[:, None] - 2 * (a * WEIGHTS) @ c.T + (c * c * WEIGHTS).sum(1)).astype(np.int64)


def closest(d: np.ndarray) -> np.ndarray:
    """Column of the least value; the last of equals."""
    return d.shape[1] - 1 - np.argmin(d[:, ::-1], axis=1)


_STATS = "image_id {kind}, p int, c int, n long, sr long, sg long, sb long, error long, removed long, far long, far_rgb int, tile_error long, tile_cell long, tile_colors array<int>"


def measured(rows: DataFrame) -> DataFrame:
    """Sums for each colour (``c`` from 0) and palette (``c`` = -1) of an image.

    ``rows``: blocks with ``palettes`` (packed colours) and ``colors`` (how many a palette has).
    ``removed``: the error of its pixels (tiles) if the colour (palette) did not exist. ``far``: the
    largest distance of a pixel, and its colour. ``tile_colors``: of the tile of the largest error the commonest colours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = block_stats(Tiles.of(batch.column("tiles")[i]), np.asarray(batch.column("palettes")[i].values).reshape(-1, batch.column("colors")[i].as_py()))
                if out:
                    frame = pa.RecordBatch.from_pylist(out, schema=stats)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("image_id")[i].as_py()] * len(out), batch.schema.field("image_id").type), *frame.columns], ["image_id", *stats.names])

    stats = pa.schema([("p", pa.int32()), ("c", pa.int32()), *[(c, pa.int64()) for c in ("n", "sr", "sg", "sb", "error", "removed", "far")], ("far_rgb", pa.int32()), ("tile_error", pa.int64()), ("tile_cell", pa.int64()), ("tile_colors", pa.list_(pa.int32()))])
    parts = rows.select("image_id", "tiles", "palettes", "colors").mapInArrow(run, _STATS.format(kind=rows.schema["image_id"].dataType.simpleString()))
    far, worst = F.max(F.struct("far", (-F.col("far_rgb")).alias("k"))), F.max(F.struct("tile_error", (-F.col("tile_cell")).alias("k"), "tile_colors"))
    return parts.groupBy("image_id", "p", "c").agg(*[F.sum(c).alias(c) for c in ("n", "sr", "sg", "sb", "error", "removed")], (-far["k"]).alias("far_rgb"), worst["tile_colors"].alias("tile_colors"))


def block_stats(tiles: Tiles, palettes: np.ndarray) -> list[dict]:
    """``measured`` of one block."""
    if not len(tiles.rgb):
        return []
    levels, colors = tiles.levels(), unpacked(palettes)
    choice = np.empty((len(colors), len(levels)), np.int64)
    cost = np.empty_like(choice)
    for p, palette in enumerate(colors):
        d = distances(levels, palette)
        choice[p] = closest(d)
        cost[p] = d[np.arange(len(d)), choice[p]]
    totals = np.stack([tiles.per_tile(c) for c in cost], axis=1)
    best = np.argmin(totals, axis=1)
    error = totals[np.arange(len(best)), best]
    others = totals.copy()
    others[np.arange(len(best)), best] = np.iinfo(np.int64).max
    second = others.min(axis=1) if len(colors) > 1 else np.zeros(len(best), np.int64)
    used = np.bincount(tiles.tile, minlength=len(best)) > 0
    out = []
    for p in np.unique(best[used]):
        mine = used & (best == p)
        own = mine[tiles.tile]
        d = distances(levels[own], colors[p])
        index, dist = choice[p][own], cost[p][own]
        d[np.arange(len(d)), index] = np.iinfo(np.int64).max
        spare = d.min(axis=1) if d.shape[1] > 1 else np.zeros(len(d), np.int64)
        worst = max(np.flatnonzero(mine), key=lambda t: (error[t], -tiles.cells[t]))
        values, counts = np.unique(tiles.rgb[tiles.tile == worst], return_counts=True)
        common = [int(v) for _, v in sorted(zip(-counts, values, strict=True))][: colors.shape[1]]
        common += [common[0]] * (colors.shape[1] - len(common))
        out.append({"p": int(p), "c": -1, "n": int(own.sum()), "error": int(error[mine].sum()), "removed": int(second[mine].sum()), "tile_error": int(error[worst]), "tile_cell": int(tiles.cells[worst]), "tile_colors": common})
        for c in np.unique(index):
            at = np.flatnonzero(index == c)
            total = levels[own][at].sum(axis=0)
            rgb, most = tiles.rgb[own][at], int(dist[at].max())
            out.append({"p": int(p), "c": int(c), "n": len(at), "sr": int(total[0]), "sg": int(total[1]), "sb": int(total[2]), "error": int(dist[at].sum()), "removed": int(spare[at].sum()), "far": most, "far_rgb": int(rgb[dist[at] == most].min())})
    return out


def next_palettes(step: str, palettes: list[list[int]], stats: dict[tuple[int, int], dict], shared: bool) -> list[list[int]]:
    """The palettes after a pass: means of what each colour drew, then what the ``step`` adds or replaces.

    ``stats`` by (palette, colour) and (palette, -1) for palettes as a whole; what drew nothing is absent.
    """
    first = 1 if shared else 0
    none = {"error": 0, "removed": 0}

    def of(p: int, c: int, what: str) -> int:
        return stats.get((p, c), none)[what]

    def worst_color(p: int) -> int:
        return max(range(len(palettes[p])), key=lambda c: (of(p, c, "error"), -c))

    out = [list(x) for x in palettes]
    for (p, c), s in stats.items():
        if c >= first:
            out[p][c] = sum((2 * s[k] + s["n"]) // (2 * s["n"]) << shift for k, shift in (("sr", 16), ("sg", 8), ("sb", 0)))
    worst = max(range(len(palettes)), key=lambda p: (of(p, -1, "error"), -p))
    if step == "palette" and (worst, -1) in stats:
        out.append(out[worst][:first] + stats[worst, -1]["tile_colors"][: len(out[worst]) - first])
    elif step == "palette":
        out.append(list(out[worst]))
    if step == "color":
        for p in range(len(palettes)):
            c = worst_color(p)
            out[p].append(stats[p, c]["far_rgb"] if (p, c) in stats else out[p][c])
    if step == "replace":
        for p in range(len(palettes)):
            c = worst_color(p)
            least = min(range(len(palettes[p])), key=lambda k: (of(p, k, "removed"), k))
            if least != c and least >= first and of(p, least, "removed") < REPLACE * of(p, c, "error"):
                out[p][least] = stats[p, c]["far_rgb"]
        weak = min(range(len(palettes)), key=lambda p: (of(p, -1, "removed"), p))
        if weak != worst and of(weak, -1, "removed") < REPLACE * of(worst, -1, "error"):
            out[weak] = out[worst][:first] + stats[worst, -1]["tile_colors"][: len(out[worst]) - first]
    return out


def schedule(palettes: int, colors: int, rounds: int, means: int, shared: bool = False) -> list[str]:
    """The steps of a training; ``best`` goes back to the best palettes so far."""
    return ["mean", *["palette"] * (palettes - 1), *["color"] * (colors - 1 - shared), *["replace"] * rounds, "best", *["mean"] * means, "best"]


def train(packed: DataFrame, palettes: int, colors: int, rounds: int = 10, means: int = 3, shared: int | DataFrame | None = None) -> DataFrame:
    """(image_id, palettes, colors, error, pixels) of each image's best palettes.

    ``packed``: blocks. ``shared``: a colour that is the first of every palette and never moves, or one for each image (image_id, zero).
    Images without a visible pixel have no row.
    """
    kind = packed.schema["image_id"].dataType.simpleString()
    columns = f"image_id {kind}, palettes array<int>, colors int, best array<int>, best_error long, pixels long"
    images, fixed = packed.select("image_id").distinct(), shared is not None
    if isinstance(shared, DataFrame):
        images, first = images.join(shared, "image_id", "left"), [F.coalesce("zero", F.lit(0)).cast("int")]
    else:
        first = [] if shared is None else [F.lit(shared)]
    state = images.select("image_id", F.array(*first, F.lit(0)).alias("palettes"), F.lit(len(first) + 1).alias("colors"), F.expr("cast(null as array<int>)").alias("best"), F.expr("cast(null as bigint)").alias("best_error"), F.lit(0).cast("long").alias("pixels"))
    full = palettes * colors

    def advance(step: str):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            first = rows.iloc[0]
            stats = {(int(r["p"]), int(r["c"])): r for r in rows.to_dict("records")}
            now = [list(map(int, x)) for x in np.asarray(first["palettes"]).reshape(-1, int(first["colors"]))]
            whole = [s for (_, c), s in stats.items() if c < 0]
            error, pixels = int(sum(s["error"] for s in whole)), int(sum(s["n"] for s in whole))
            best, best_error = first["best"], first["best_error"]
            if len(now) * len(now[0]) == full and (best is None or error < best_error):
                best, best_error = [c for x in now for c in x], error
            for s in stats.values():
                s["tile_colors"] = [] if s["tile_colors"] is None else [int(c) for c in s["tile_colors"]]
            after = [list(map(int, x)) for x in np.asarray(best).reshape(-1, colors)] if step == "best" else next_palettes(step, now, stats, fixed)
            row = {"image_id": first["image_id"], "palettes": [int(c) for x in after for c in x], "colors": len(after[0]), "best": None if best is None else [int(c) for c in best], "best_error": best_error, "pixels": pixels}
            return pd.DataFrame([row])

        return run

    sums = ["p", "c", "n", "sr", "sg", "sb", "error", "removed", "far_rgb", "tile_colors"]
    for step in schedule(palettes, colors, rounds, means, fixed):
        stats = measured(with_palettes(packed, state.select("image_id", "palettes", "colors"), full))
        filled = stats.select("image_id", *[F.coalesce(c, F.lit(0)).alias(c) if c != "tile_colors" else F.col(c) for c in sums])
        after = stored(filled.join(state, "image_id").groupBy("image_id").applyInPandas(advance(step), columns))
        if hasattr(state, "stored_at"):
            release(state)
        state = after
    return state.select("image_id", "palettes", "colors", F.col("best_error").alias("error"), "pixels")


def listed(trained: DataFrame) -> DataFrame:
    """Palettes as rows: image_id, palette, i, r, g, b."""
    rows = trained.select("image_id", "colors", F.posexplode("palettes").alias("k", "rgb"))
    parts = [F.shiftright("rgb", s).bitwiseAND(F.lit(255)).alias(c) for c, s in (("r", 16), ("g", 8), ("b", 0))]
    return rows.select("image_id", F.floor(F.col("k") / F.col("colors")).cast("int").alias("palette"), (F.col("k") % F.col("colors")).cast("int").alias("i"), *parts)


def table_of(palettes: DataFrame, bits: int = 8, megadrive: bool = False) -> DataFrame:
    """Stored palette rows (image_id, palette, i, r, g, b) as one row for each image, in the colours of ``bits`` a channel.

    All palettes of an image must have the same number of colours; it is at most 16 palettes of 256.
    """
    rgb = (F.shiftleft("r", 16) + F.shiftleft("g", 8) + F.col("b")).cast("int")
    rgb = reduced_rgb(rgb, bits, megadrive) if bits < 8 or megadrive else rgb
    rows = palettes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("palette", "i", rgb.alias("rgb")))).alias("e"), (F.max("i") + 1).cast("int").alias("colors"))
    return rows.select("image_id", F.transform("e", lambda x: x["rgb"]).alias("palettes"), "colors")


@dataclass(frozen=True)
class Dither:
    """Ordered dithering in linear light: the ``pattern`` (0-5) picks one of 4 (patterns 0-2) or 2 candidates by brightness."""

    pattern: int
    weight: float

    @property
    def candidates(self) -> int:
        return 4 if self.pattern < 3 else 2

    def draw(self, levels: np.ndarray, palette: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and distance of the candidate that the pattern picks for each pixel."""
        linear, squares = levels.astype(np.float64) ** 2, palette.astype(np.float64) ** 2
        bright, colors = squares @ _BRIGHT, palette.astype(np.float64)
        error, found = np.zeros_like(linear), []
        for _ in range(self.candidates):
            aim = np.sqrt(np.clip(linear + error * self.weight, 0, 255 * 255))
            d = (((aim[:, None, :] - colors) ** 2) * WEIGHTS).sum(axis=2)
            index = closest(d)
            found.append([bright[index], index, d[np.arange(len(d)), index]])
            error += linear - squares[index]
        for i in range(len(found) - 1):
            for j in range(i + 1, len(found)):
                swap = found[i][0] > found[j][0]
                for k in range(3):
                    found[i][k], found[j][k] = np.where(swap, found[j][k], found[i][k]), np.where(swap, found[i][k], found[j][k])
        nth = np.asarray(model.DITHER_PATTERNS[self.pattern])[x & 1, y & 1]
        return np.choose(nth, [f[1] for f in found]), np.choose(nth, [f[2] for f in found])


def render(packed: DataFrame, palettes: DataFrame, dither: Dither | None = None, bits: int = 8, tile_width: int = 8, megadrive: bool = False) -> DataFrame:
    """Each tile drawn with its best palette: image_id, cell, palette, indexes (-1 where transparent), error, colors (packed, as shown).

    ``palettes``: stored rows (image_id, palette, i, r, g, b), of a finished or a stopped training.
    With ``dither`` a tile's palette is that of the least *dithered* error. A tile without a visible pixel has palette 0.
    """
    table = table_of(palettes, bits, megadrive)
    most = palettes.groupBy("image_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    kind = packed.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tiles, across = Tiles.of(batch.column("tiles")[k]), batch.column("tiles_x")[k].as_py()
                packed_colors = np.asarray(batch.column("palettes")[k].values).reshape(-1, batch.column("colors")[k].as_py())
                levels, colors, n = tiles.levels(), unpacked(packed_colors), len(tiles.cells)
                x = tiles.cells[tiles.tile] % across * tile_width + tiles.place % tile_width
                y = tiles.cells[tiles.tile] // across * (tiles.width // tile_width) + tiles.place // tile_width
                drawn = []
                for palette in colors:
                    if dither:
                        drawn.append(dither.draw(levels, palette, x, y))
                    else:
                        d = distances(levels, palette)
                        drawn.append((closest(d), d.min(axis=1, initial=np.iinfo(np.int64).max).astype(np.float64)))
                totals = np.stack([np.bincount(tiles.tile, weights=d, minlength=n) for _, d in drawn], axis=1)
                best = np.argmin(totals, axis=1)
                indexes = np.full((n, tiles.width), -1, np.int32)
                shown = np.full((n, tiles.width), -1, np.int32)
                for p, (index, _) in enumerate(drawn):
                    own = best[tiles.tile] == p
                    indexes[tiles.tile[own], tiles.place[own]] = index[own]
                    shown[tiles.tile[own], tiles.place[own]] = packed_colors[p][index[own]]
                at = pa.array(np.arange(n + 1, dtype=np.int32) * tiles.width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("image_id")[k].as_py()] * n, batch.schema.field("image_id").type), pa.array(tiles.cells), pa.array(best.astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(indexes.ravel())), pa.array(totals[np.arange(n), best]), pa.ListArray.from_arrays(at, pa.array(shown.ravel()))],
                    ["image_id", "cell", "palette", "indexes", "error", "colors"],
                )

    return with_palettes(packed, table, most).select("image_id", "tiles", "tiles_x", "palettes", "colors").mapInArrow(run, f"image_id {kind}, cell long, palette int, indexes array<int>, error double, colors array<int>")


def finish_partial(packed: DataFrame, checkpoint: DataFrame, dither: Dither, bits: int = 8) -> DataFrame:
    """The image that a stopped training gives: its stored palettes, reduced to ``bits``, drawn with dithering."""
    return render(packed, checkpoint, dither, bits)


def quantize(pixels: DataFrame, sizes: DataFrame, palettes: int, colors: int, bits: int = 8, megadrive: bool = False, dither: Dither | None = None, shared: bool = False, rounds: int = 10, tile: int = 8) -> dict[str, DataFrame]:
    """The whole job on images (image_id, x, y, r, g, b, a; image_id, width, height): reduce, train, sort, render.

    Pixels are reduced first unless they are dithered. With ``shared``, the commonest opaque colour is the first of every
    palette. Returns ``palettes`` (image_id, palette, i, r, g, b, as shown, sorted) and ``cells`` as ``render`` gives them.
    """
    tiles = cut_tiles(pixels, sizes, tile, tile)
    reduce = bits < 8 or megadrive
    packed = blocks(reduced_tiles(tiles, bits, megadrive) if reduce and dither is None else tiles)
    trained = train(packed, palettes, colors, rounds, shared=opaque_mode(pixels) if shared else None)
    shown = reduced_rgb(F.col("rgb"), bits, megadrive) if reduce else F.col("rgb")
    rows = trained.select("image_id", "colors", F.posexplode("palettes").alias("k", "rgb")).withColumn("rgb", shown)
    rows = rows.select("image_id", F.floor(F.col("k") / F.col("colors")).cast("int").alias("palette"), (F.col("k") % F.col("colors")).cast("int").alias("i"), *[F.shiftright("rgb", s).bitwiseAND(F.lit(255)).alias(c) for c, s in (("r", 16), ("g", 8), ("b", 0))])
    ordered = stored(sorted_palettes(rows, 1 if shared else 0))
    return {"palettes": ordered, "cells": render(packed, ordered, dither, bits, tile, megadrive)}


def tile_pixels(rows: DataFrame, r: Column, g: Column, b: Column, tiles_x: int) -> DataFrame:
    """Tiles of rows (image_id, cell) with arrays of 64 channel levels."""
    rgb = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.shiftleft(F.get(r, p), 16) + F.shiftleft(F.get(g, p), 8) + F.get(b, p))
    return rows.select("image_id", "cell", F.lit(tiles_x).cast("long").alias("tiles_x"), rgb.alias("pixels"))
