"""Maps with the files that they name: maps, tilesets and tileset images resolved into relations, and layers drawn.

Files (``path``, ``content``) that belong together have the same ``bundle`` (a folder, an upload); in
it names are matched without their folders and without regard to case. A map is left out with a
diagnostic, never silently: its file or one that it names is missing or cannot be read, a tileset is a
collection of images or has tiles of another size, palettes differ, or there is no tileset.

A file is parsed in Python, a row a file; a tileset image is cut into tiles where it is decoded.
Everything else are joins: references by base name, cells with tilesets as of their first ids, cells
with tiles. Empty cells are index 0, and cells without a tile are kept and counted.
"""

from __future__ import annotations

import functools
import json
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import tiles as tile_ops
from ..operators.tiles import BROADCAST_BYTES
from ..working import stored, stored_bytes
from . import png
from .tiled import ID_MASK, _tileset, parse

_SET = "firstgid long, source string, tilewidth int, tileheight int, columns int, margin int, spacing int, tilecount int, image string"
_MAPS = f"bundle string, path string, width int, height int, tile_width int, tile_height int, tilesets array<struct<{_SET.replace(' ', ': ').replace(',:', ',')}>>, layers array<struct<layer: string, gids: array<bigint>>>, error string"
_BROKEN = (ValueError, KeyError, TypeError, ET.ParseError, zlib.error, OSError)


def name_of(path: Column) -> Column:
    """What stands behind the last slash or backslash, in lower case."""
    return F.lower(F.regexp_extract(path, r"([^\\/]*)$", 1))


def in_bundles(files: DataFrame) -> DataFrame:
    """``files`` with a ``bundle`` (their folder, where there is none) and their base ``name``."""
    rows = files if "bundle" in files.columns else files.withColumn("bundle", F.regexp_replace("path", r"[^\\/]*$", ""))
    return rows.select(F.col("bundle").cast("string").alias("bundle"), "path", "content", name_of(F.col("path")).alias("name"))


def maps(files: DataFrame) -> DataFrame:
    """One row for each map file (.tmx, .tmj): sizes, tileset references, layers, or an ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bundle, path, content in zip(*(batch.column(c).to_pylist() for c in ("bundle", "path", "content")), strict=True):
                row = dict.fromkeys(("width", "height", "tile_width", "tile_height", "tilesets", "layers", "error")) | {"bundle": bundle, "path": path}
                try:
                    m = parse(content)
                    row |= {"width": m.width, "height": m.height, "tile_width": m.tile_width, "tile_height": m.tile_height, "tilesets": m.tilesets, "layers": [{"layer": name, "gids": gids} for name, gids in m.layers]}
                except _BROKEN as e:
                    row["error"] = str(e) or type(e).__name__
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tileset = pa.struct([("firstgid", pa.int64()), ("source", pa.string()), *[(c, pa.int32()) for c in ("tilewidth", "tileheight", "columns", "margin", "spacing", "tilecount")], ("image", pa.string())])
    schema = pa.schema([("bundle", pa.string()), ("path", pa.string()), *[(c, pa.int32()) for c in ("width", "height", "tile_width", "tile_height")], ("tilesets", pa.list_(tileset)), ("layers", pa.list_(pa.struct([("layer", pa.string()), ("gids", pa.list_(pa.int64()))]))), ("error", pa.string())])
    return files.where(F.col("name").rlike(r"\.(tmx|tmj)$")).select("bundle", "path", "content").mapInArrow(run, _MAPS)


def main_files(files: DataFrame) -> DataFrame:
    """The file that each bundle is opened by: bundle, path, kind. A map wins over an image, an image over any other; of several the first by path."""
    rows = in_bundles(files)
    kind = F.when(F.col("name").rlike(r"\.(tmx|tmj)$"), 0).when(F.col("name").rlike(r"\.png$"), 1).otherwise(2)
    best = rows.groupBy("bundle").agg(F.min(F.struct(kind.alias("kind"), "path")).alias("f"))
    return best.select("bundle", "f.path", F.element_at(F.array(*map(F.lit, ("map", "image", "other"))), F.col("f.kind") + 1).alias("kind"))


def chosen_layers(layers: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The layer to draw of each map: its only one, or that of the name given (path, layer), the first of equals. Maps without a choice have no row."""
    count = layers.groupBy("path").agg(F.count("*").alias("n"))
    only = layers.join(count.where("n = 1"), "path").drop("n")
    if names is None:
        return only
    named = layers.join(count.where("n > 1").select("path"), "path", "left_semi").join(names.distinct(), ["path", "layer"], "left_semi")
    first = named.groupBy("path").agg(F.min("nth").alias("nth"))
    return only.unionByName(named.join(first, ["path", "nth"], "left_semi").select(*only.columns))


def parse_tileset(content: bytes) -> dict:
    """A tileset file (.tsx, .tsj) as ``parse`` gives inline ones."""
    text = content.decode("utf-8")
    if text.lstrip().startswith("{"):
        doc = json.loads(text)
        return _tileset(doc.get, doc.get("image"))
    root = ET.fromstring(text)
    image = root.find("image")
    return _tileset(root.get, None if image is None else image.get("source"))


def tileset_files(files: DataFrame) -> DataFrame:
    """One row for each tileset file: its fields, or an ``error``."""
    names = ["tilewidth", "tileheight", "columns", "margin", "spacing", "tilecount", "image"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bundle, name, content in zip(*(batch.column(c).to_pylist() for c in ("bundle", "name", "content")), strict=True):
                row = {"bundle": bundle, "name": name, "error": None}
                try:
                    found = parse_tileset(content)
                    row |= {c: found[c] for c in names}
                except _BROKEN as e:
                    row["error"] = str(e) or type(e).__name__
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("bundle", pa.string()), ("name", pa.string()), *[(c, pa.int32()) for c in names[:-1]], ("image", pa.string()), ("error", pa.string())])
    return files.where(F.col("name").rlike(r"\.(tsx|tsj|json)$")).select("bundle", "name", "content").mapInArrow(run, "bundle string, name string, tilewidth int, tileheight int, columns int, margin int, spacing int, tilecount int, image string, error string")


_CUT = "path string, firstgid long, id long, pixels array<int>, palette binary, alpha binary, error string"


def cut_images(sets: DataFrame) -> DataFrame:
    """The tiles of tilesets with the ``content`` of their images: path, firstgid, id, pixels (row by row), palette, alpha.

    A tileset has at least one row; without whole tiles it has no id, and where the image cannot be read an ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                head = {"path": t["path"], "firstgid": t["firstgid"], "id": None, "pixels": None, "palette": None, "alpha": None, "error": None}
                try:
                    image = png.decode(t["content"])
                except _BROKEN as e:
                    yield pa.RecordBatch.from_pylist([head | {"error": str(e) or type(e).__name__}], schema=schema)
                    continue
                w, h, margin, step = t["tilewidth"], t["tileheight"], t["margin"], t["spacing"]
                columns = t["columns"] or (image.width - 2 * margin + step) // (w + step)
                rows = [head | {"palette": image.palette, "alpha": image.alpha}]
                for y in range((image.height - margin + step) // (h + step)):
                    for x in range(columns):
                        left, top = margin + x * (w + step), margin + y * (h + step)
                        if left + w <= image.width and top + h <= image.height:
                            rows.append(head | {"id": y * columns + x, "pixels": image.indexes[top : top + h, left : left + w].ravel().tolist()})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("path", pa.string()), ("firstgid", pa.int64()), ("id", pa.int64()), ("pixels", pa.list_(pa.int32())), ("palette", pa.binary()), ("alpha", pa.binary()), ("error", pa.string())])
    return sets.select("path", "firstgid", "tilewidth", "tileheight", "columns", "margin", "spacing", "content").mapInArrow(run, _CUT)


def load(files: DataFrame) -> dict[str, DataFrame]:
    """``diagnostics`` (path, code, detail), and of maps without any: ``maps`` (path, width, height, tile_width,
    tile_height, palette, alpha), ``tilesets`` (path, firstgid), ``layers`` (path, nth, layer, gids) and ``tiles`` (path, firstgid, id, pixels).

    ``files``: path, content, and the ``bundle`` that they belong to.
    """
    files = in_bundles(files)
    every = stored(maps(files))
    good = every.where("error is null")
    refs = good.select("bundle", "path", "tile_width", "tile_height", F.explode("tilesets").alias("t")).select("bundle", "path", "tile_width", "tile_height", "t.*")
    outer = refs.where("source is not null").select("bundle", "path", "tile_width", "tile_height", "firstgid", "source", name_of(F.col("source")).alias("name"))
    named = outer.join(tileset_files(files).withColumn("there", F.lit(True)), ["bundle", "name"], "left")
    missing = named.where("there is null").select("path", F.lit("missing-file").alias("code"), F.regexp_extract("source", r"([^\\/]*)$", 1).alias("detail"))
    broken = named.where("error is not null").select("path", F.lit("unreadable").alias("code"), F.concat_ws(": ", "name", "error").alias("detail"))
    columns = ["bundle", "path", "tile_width", "tile_height", "firstgid", "tilewidth", "tileheight", "columns", "margin", "spacing", "image"]
    sets = stored(refs.where("source is null").select(*columns).unionByName(named.where("there and error is null").select(*columns)))
    odd = sets.where("image is null").select("path", F.lit("image-collection").alias("code"), F.lit(None).cast("string").alias("detail"))
    size = sets.where("image is not null and (tilewidth <> tile_width or tileheight <> tile_height)")
    size = size.select("path", F.lit("tile-size").alias("code"), F.concat_ws("x", "tilewidth", "tileheight").alias("detail"))
    fine = sets.where("image is not null and tilewidth = tile_width and tileheight = tile_height").withColumn("name", name_of(F.col("image")))
    images = files.where(F.col("name").rlike(r"\.png$")).select("bundle", "name", "content", F.lit(True).alias("there"))
    with_image = fine.join(images, ["bundle", "name"], "left")
    no_image = with_image.where("there is null").select("path", F.lit("missing-file").alias("code"), F.regexp_extract("image", r"([^\\/]*)$", 1).alias("detail"))
    cut = stored(cut_images(with_image.where("there")))
    bad_image = cut.where("error is not null").select("path", F.lit("unreadable").alias("code"), F.col("error").alias("detail"))
    first = F.min_by(F.struct("palette", "alpha"), "firstgid")
    palettes = cut.where("palette is not null").groupBy("path").agg(first.alias("first"), F.count_distinct("palette").alias("n"))
    mixed = palettes.where("n > 1").select("path", F.lit("palette").alias("code"), F.lit(None).cast("string").alias("detail"))
    empty = good.where(F.size("tilesets") == 0).select("path", F.lit("no-tilesets").alias("code"), F.lit(None).cast("string").alias("detail"))
    found = every.where("error is not null").select("path", F.lit("unreadable").alias("code"), F.col("error").alias("detail"))
    for more in (missing, broken, odd, size, no_image, bad_image, mixed, empty):
        found = found.unionByName(more)
    found = stored(found.distinct())
    left = found.select("path").distinct()
    passed = good.join(left, "path", "left_anti")
    return {
        "diagnostics": found,
        "maps": passed.join(palettes, "path").select("path", "width", "height", "tile_width", "tile_height", "first.palette", "first.alpha"),
        "tilesets": sets.select("path", "firstgid").join(left, "path", "left_anti"),
        "layers": passed.select("path", F.posexplode("layers").alias("nth", "l")).select("path", "nth", "l.layer", "l.gids"),
        "tiles": cut.where("id is not null").select("path", "firstgid", "id", "pixels").join(left, "path", "left_anti"),
    }


#: Tile ids that are matched with tilesets in one task.
STRETCH = 1 << 12


def tiles_as_of(cells: DataFrame, tilesets: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Cells (keys, raw) with ``gid`` (0 where empty), ``firstgid`` of the last tileset that begins by then (null if there is none) and ``id``.

    Distinct ids meet the tilesets in stretches of ids; what a stretch has from before it is the last tileset of an
    earlier one. Neither the cells nor the tilesets of a map are gathered.
    """
    rows = cells.withColumn("gid", F.col("raw").bitwiseAND(F.lit(ID_MASK).cast("long")))
    asked = rows.where("gid > 0").select(*keys, "gid").distinct().select(*keys, F.col("gid").alias("_at"), F.lit(None).cast("long").alias("_first"))
    begun = tilesets.select(*keys, F.col("firstgid").cast("long").alias("_at"), F.col("firstgid").cast("long").alias("_first")).where("_at is not null").distinct()
    placed = asked.unionByName(begun).withColumn("_stretch", F.floor(F.col("_at") / STRETCH))
    run = Window.partitionBy(*keys, "_stretch").orderBy("_at", F.col("_first").asc_nulls_last())
    within = placed.withColumn("_last", F.last("_first", ignorenulls=True).over(run))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    before = placed.groupBy(*keys, "_stretch").agg(F.max("_first").alias("_top")).select(*keys, "_stretch", F.max("_top").over(earlier).alias("_before"))
    known = within.where("_first is null").join(before, [*keys, "_stretch"]).select(*keys, F.col("_at").alias("gid"), F.coalesce("_last", "_before").alias("firstgid"))
    out = _looked_up(rows, stored(known.where("firstgid is not null")), [*keys, "gid"])
    return out.withColumn("id", F.col("gid") - F.col("firstgid"))


def _looked_up(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of ``found`` (stored, a row for each key), or null. Rows that lack a key are dealt out, not gathered."""
    if stored_bytes(found) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), on, "left")
    lacks = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    spread = rows.withColumn("_spread", F.when(lacks, F.xxhash64(*rows.columns)).otherwise(0))
    return spread.join(found.withColumn("_spread", F.lit(0).cast("long")).hint("merge"), [*on, "_spread"], "left").drop("_spread")


def drawn(cells: DataFrame, tiles: DataFrame, width: Column, height: Column, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``tiles_as_of`` cells with ``pixels`` (row by row, as shown) and ``state``: tile, empty or outside (no pixels).

    A tile is drawn once for each way in which cells of its map turn it. Cells are flipped after the diagonal swap, so
    the swap is undone last.
    """
    flips = F.shiftright("raw", 29).bitwiseAND(F.lit(7).cast("long")).cast("int")
    rows = cells.withColumn("_w", width.cast("int")).withColumn("_h", height.cast("int")).withColumn("_flips", F.when(F.col("firstgid").isNotNull(), flips))
    on = [*keys, "firstgid", "id", "_flips", "_w", "_h"]
    used = stored(rows.where("firstgid is not null").select(*on).distinct())
    bit = lambda b: F.shiftright("_flips", b).bitwiseAND(1) == 1
    w, h = F.col("_w"), F.col("_h")

    def at(p: Column) -> Column:
        x, y = p % w, F.floor(p / w).cast("int")
        u, v = F.when(bit(2), w - 1 - x).otherwise(x), F.when(bit(1), h - 1 - y).otherwise(y)
        return F.get("_source", (F.when(bit(0), u).otherwise(v) * w + F.when(bit(0), v).otherwise(u)).cast("int"))

    sources = tile_ops.looked_up(tiles.select(*keys, "firstgid", "id", F.col("pixels").alias("_source")), used, [*keys, "firstgid", "id"]).where("_source is not null")
    turned = stored(sources.select(*on, F.transform(F.sequence(F.lit(0), w * h - 1), at).alias("pixels")))
    out = _looked_up(rows, turned, on)
    state = F.when(F.col("gid") == 0, "empty").when(F.col("pixels").isNull(), "outside").otherwise("tile")
    return out.withColumn("state", state).withColumn("pixels", F.when(F.col("gid") == 0, F.array_repeat(F.lit(0), w * h)).otherwise(F.col("pixels"))).drop("_flips", "_w", "_h")


def flatten(loaded: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The layers of loaded maps: cells (path, nth, layer, cell, pixels), and the tiles that lie outside their image (path, layer, gid, cells)."""
    cells = loaded["layers"].select("path", "nth", "layer", F.posexplode("gids").alias("cell", "raw"))
    placed = tiles_as_of(cells, loaded["tilesets"]).join(loaded["maps"].select("path", "tile_width", "tile_height"), "path")
    out = drawn(placed, loaded["tiles"], F.col("tile_width"), F.col("tile_height"))
    outside = out.where("state = 'outside'").groupBy("path", "layer", "gid").agg(F.count("*").alias("cells"))
    return out.select("path", "nth", "layer", "cell", "state", "pixels"), outside
