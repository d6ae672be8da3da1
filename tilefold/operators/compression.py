"""Lossy tile compression on raw channel bytes: exact and mirrored duplicates, tolerance, retention, nearest kept tile.

A tile is a binary of 64 pixels times ``channels`` bytes. Four steps, none of which holds an image
in one task:

1. Distinct patterns, and classes of patterns that are mirror images of each other.
2. Leaders. In scan order a class joins the first leader within the tolerance, else it leads. This is
   the first independent set in scan order, found in rounds: a class is decided once all earlier
   classes near it are. Nearness is never listed pair by pair; packed chunks of classes meet other
   chunks, and each class gets back only whether a leader or an undecided class before it is near.
   Sums of bytes bound distances from below (the triangle inequality): chunks are cut along the sum
   over the tile and meet only where these overlap, and sums over the four mirrored places rule out
   most pairs before bytes are compared.
3. The most used tiles are kept, marked ones first.
4. Every other tile takes its nearest kept one: blocks of tiles times blocks of kept tiles and
   their mirror images as matrix products, partial minima, one merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..working import stored
from .tiles import looked_up, numbered, retained

#: Tiles of a chunk; a pair of chunks is one unit of work.
CHUNK = 512
#: Values that are compared byte by byte at once.
PAIRS = 4096
#: Mirror images in the order in which they are tried: flags 0 to 3 (1 horizontal, 2 vertical).
FLIPS = np.stack([np.arange(64) ^ mask for mask in (0, 7, 56, 63)])
_FAR = (1 << 62) - 1


def bytes_of(column: pa.Array, channels: int) -> np.ndarray:
    """Binaries as a matrix tiles x 64 x channels."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 64, channels)


def rgba_pattern(pixels: Column) -> Column:
    """A binary of an array of 64 structs r, g, b, a."""
    return F.unhex(F.array_join(F.transform(pixels, lambda p: F.concat(*[F.lpad(F.hex(p[c].cast("int")), 2, "0") for c in "rgba"])), ""))


def value_pattern(tile: Column) -> Column:
    """A binary of an array of 64 byte values."""
    return F.unhex(F.array_join(F.transform(tile, lambda v: F.lpad(F.hex(v.cast("int")), 2, "0")), ""))


def canonical(tiles: np.ndarray) -> np.ndarray:
    """The least of each tile's four mirror images, byte by byte."""
    best = tiles.reshape(len(tiles), -1).copy()
    for order in FLIPS[1:]:
        other = tiles[:, order].reshape(len(tiles), -1)
        differ = best != other
        at = differ.argmax(axis=1)
        rows = np.arange(len(best))
        less = differ.any(axis=1) & (other[rows, at] < best[rows, at])
        best[less] = other[less]
    return best


def with_canon(patterns: DataFrame, flips: bool, channels: int) -> DataFrame:
    """``patterns`` with ``canon`` (shared by mirror images) and ``total`` (the sum of its bytes)."""
    schema = patterns.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = bytes_of(batch.column("pattern"), channels)
            canon = canonical(tiles) if flips else tiles.reshape(len(tiles), -1)
            total = tiles.reshape(len(tiles), -1).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in canon], pa.binary()), pa.array(total)], [*batch.schema.names, "canon", "total"])

    return patterns.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", canon binary, total long")


def chunks(rows: DataFrame, columns: list[str], order: str | None = "total") -> DataFrame:
    """Rows in chunks of an image along ``order``: image_id, chunk, lo, hi, and one array of structs ``rows``."""
    spread = numbered(rows.withColumn("_order", (F.col(order) if order else F.lit(0)) * (1 << 40) + F.col("idx")), "_order", "nth")
    grouped = spread.groupBy("image_id", F.floor(F.col("nth") / CHUNK).alias("chunk"))
    ends = [F.min(order).alias("lo"), F.max(order).alias("hi")] if order else []
    return grouped.agg(*ends, F.collect_list(F.struct(*columns)).alias("rows"))


def met(left: DataFrame, right: DataFrame, reach: float | None) -> DataFrame:
    """Pairs of chunks (``a``, ``b``) of one image, if ``reach`` is given only those whose sums come so near.

    An image's left chunks are dealt to about the root of their number of shards, to each of which its
    right chunks are copied, so that a large image is not one task's.
    """
    shards = left.groupBy("image_id").agg(F.ceil(F.sqrt(F.count("*"))).cast("int").alias("shards"))
    ends = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("lo", "hi")] if reach is not None else []
    a = left.join(shards, "image_id").select("image_id", F.pmod(F.col("chunk"), F.col("shards")).cast("int").alias("shard"), F.col("rows").alias("a"), *ends("a"))
    b = right.join(shards, "image_id").select("image_id", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.col("rows").alias("b"), *ends("b"))
    pairs = a.join(b, ["image_id", "shard"])
    if reach is not None:
        pairs = pairs.where((F.col("b_lo") <= F.col("a_hi") + reach) & (F.col("b_hi") >= F.col("a_lo") - reach))
    return pairs.select("image_id", "a", "b")


@dataclass
class Chunk:
    idx: np.ndarray
    tiles: np.ndarray
    extra: dict[str, np.ndarray]

    @classmethod
    def of(cls, column: pa.ListScalar, channels: int) -> Chunk:
        values = column.values
        names = [f.name for f in values.type]
        extra = {n: np.asarray(values.field(n)) for n in names if n not in ("idx", "pattern")}
        return cls(np.asarray(values.field("idx")), bytes_of(values.field("pattern"), channels), extra)

    def mirrored_sums(self) -> np.ndarray:
        """Sums over the four places that mirroring exchanges: the same for all mirror images."""
        return sum(self.tiles[:, order].astype(np.int32) for order in FLIPS)[:, [y * 8 + x for y in range(4) for x in range(4)]].reshape(len(self.tiles), -1)


def near_pairs(a: Chunk, b: Chunk, possible: np.ndarray, limit: float, flips: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``possible`` (a matrix) whose summed absolute difference is within ``limit``, mirrored or not."""
    sums = [c.tiles.reshape(len(c.tiles), -1).sum(axis=1, dtype=np.int64) for c in (a, b)]
    i, j = np.nonzero(possible & (np.abs(sums[0][:, None] - sums[1]) <= limit))
    near = np.zeros(len(i), bool)
    left, right = a.mirrored_sums(), b.mirrored_sums()
    for s in range(0, len(i), PAIRS):
        part = slice(s, s + PAIRS)
        x, y = i[part], j[part]
        some = np.flatnonzero(np.abs(left[x] - right[y]).sum(axis=1) <= limit)
        ta, tb = a.tiles[x[some]].astype(np.int16), b.tiles[y[some]].astype(np.int16)
        found = np.zeros(len(some), bool)
        for order in FLIPS[: 4 if flips else 1]:
            found |= np.abs(ta - tb[:, order]).sum(axis=(1, 2), dtype=np.int64) <= limit
        near[s + some] = found
    return i[near], j[near]


def _over_pairs(pairs: DataFrame, channels: int, compute, columns: str) -> DataFrame:
    """``compute`` of each pair of chunks: (idx, *values) for rows of ``a``."""
    kind = pairs.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (Chunk.of(batch.column(c)[k], channels) for c in "ab")
                out = [pa.array(c) for c in compute(a, b)]
                if len(out[0]):
                    names = pa.array([batch.column("image_id")[k].as_py()] * len(out[0]), batch.schema.field("image_id").type)
                    yield pa.RecordBatch.from_arrays([names, *out], ["image_id", *[c.split()[0] for c in columns.split(", ")]])

    return pairs.select("image_id", "a", "b").mapInArrow(run, f"image_id {kind}, {columns}")


def leaders(classes: DataFrame, limit: float, flips: bool, channels: int) -> DataFrame:
    """``classes`` (image_id, idx: first cell, marked: first marked cell or null, pattern, total) with ``leads`` (the
    cell from which the class is a tile of its own, or null) and ``joins`` (the cell from which the leader that it joins led, or null).

    A class leads from its first cell if that is marked or no leader before it is near, else from its first marked cell.
    """
    undecided, leading, joined = 0, 1, 2
    first_marked = F.col("marked") == F.col("idx")
    rows = stored(classes.withColumn("state", F.when(first_marked | F.lit(limit <= 0), leading).otherwise(undecided)))

    def before(a: Chunk, b: Chunk) -> tuple[np.ndarray, ...]:
        """Is a leader (2) or an undecided class (1) near that leads, or may lead, before the class comes?"""
        early = b.idx[None, :] < a.idx[:, None]
        sure = (early & (b.extra["state"] == leading)) | (b.extra["marked"][None, :] < a.idx[:, None])
        maybe = early & (b.extra["state"] == undecided)
        i, j = near_pairs(a, b, sure | maybe, limit, flips)
        out = np.zeros(len(a.idx), np.int32)
        np.maximum.at(out, i, np.where(sure[i, j], 2, 1).astype(np.int32))
        some = np.flatnonzero(out)
        return a.idx[some], out[some]

    columns = ["idx", "pattern", "state", F.coalesce("marked", F.lit(_FAR)).alias("marked")]
    while limit > 0 and not rows.where(F.col("state") == undecided).isEmpty():
        # what has joined and is never marked cannot hold anyone off
        others = chunks(rows.where((F.col("state") != joined) | F.col("marked").isNotNull()), columns)
        found = _over_pairs(met(chunks(rows.where(F.col("state") == undecided), columns), others, limit), channels, before, "idx long, found int")
        seen = found.groupBy("image_id", "idx").agg(F.max("found").alias("found"))
        state = F.when(F.col("state") != undecided, F.col("state")).when(F.col("found") == 2, joined).when(F.col("found") == 1, undecided).otherwise(leading)
        rows = stored(rows.join(seen, ["image_id", "idx"], "left").withColumn("state", state).drop("found"), instead_of=rows)
    rows = rows.withColumn("leads", F.when(F.col("state") == leading, F.col("idx")).otherwise(F.col("marked")))

    def earliest(a: Chunk, b: Chunk) -> tuple[np.ndarray, ...]:
        i, j = near_pairs(a, b, b.extra["leads"][None, :] < a.idx[:, None], limit, flips)
        out = np.full(len(a.idx), _FAR)
        np.minimum.at(out, i, b.extra["leads"][j])
        some = np.flatnonzero(out < _FAR)
        return a.idx[some], out[some]

    if limit <= 0:
        return rows.withColumn("joins", F.lit(None).cast("long")).drop("state")
    to = chunks(rows.where("leads is not null"), ["idx", "pattern", "leads"])
    found = _over_pairs(met(chunks(rows.where(F.col("state") == joined), ["idx", "pattern"]), to, limit), channels, earliest, "idx long, joins long")
    return rows.join(found.groupBy("image_id", "idx").agg(F.min("joins").alias("joins")), ["image_id", "idx"], "left").drop("state")


def first_flags(rows: DataFrame, limit: float, flips: bool, channels: int) -> DataFrame:
    """``rows`` with ``flags``: of the mirror images of ``drawn`` the first within ``limit`` of ``pattern``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (bytes_of(batch.column(c), channels).astype(np.int16) for c in ("pattern", "drawn"))
            flags = np.full(len(a), -1, np.int32)
            for f, order in enumerate(FLIPS[: 4 if flips else 1]):
                near = np.abs(a - b[:, order]).sum(axis=(1, 2), dtype=np.int64) <= limit
                flags[(flags < 0) & near] = f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags)], [*batch.schema.names, "flags"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", flags int")


def merged(cells: DataFrame, tolerance: float = 0, flips: bool = False, channels: int = 4) -> tuple[DataFrame, DataFrame]:
    """Cells (image_id, cell, pattern, marked) with ``tile`` and ``flags``, and the tiles.

    Returns ``cells`` (image_id, cell, id of its pattern ``pid``, tile, flags, exact: whether the pattern is
    the tile's) and ``tiles`` (image_id, tile, drawn: its pattern). ``tolerance``: mean absolute difference of a byte.
    """
    return merged_patterns(cells, tolerance, flips, channels)[:2]


def merged_patterns(cells: DataFrame, tolerance: float, flips: bool, channels: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``merged``, and the distinct patterns (image_id, pid: the first cell of the pattern, pattern).

    Cells are read twice: for their patterns, and for the pattern's id that stands for it from then on.
    """
    limit = float(tolerance) * 64 * channels
    marked = F.min(F.when(F.col("marked"), F.col("cell")))
    patterns = cells.groupBy("image_id", "pattern").agg(F.min("cell").alias("pid"), marked.alias("marked"))
    patterns = stored(with_canon(patterns, flips, channels))
    grouped = patterns.groupBy("image_id", "canon")
    classes = grouped.agg(F.min("pid").alias("idx"), F.min("marked").alias("marked"), F.min("total").alias("total"), F.min_by("pattern", "pid").alias("at_first"), F.min_by("pattern", F.coalesce("marked", F.lit(_FAR))).alias("at_marked"))
    led = leaders(classes.withColumn("pattern", F.col("at_first")), limit, flips, channels)
    led = stored(led.withColumn("drawn", F.when(F.col("leads") == F.col("idx"), F.col("at_first")).otherwise(F.col("at_marked"))).select("image_id", "canon", "leads", "joins", "drawn"))
    tiles = stored(numbered(led.where("leads is not null").select("image_id", "leads", "drawn"), "leads", "tile"))

    # each pattern may stand for its own tile from ``leads`` on, and before that for the one that it joins
    mine = patterns.join(led.select("image_id", "canon", "leads", "joins"), ["image_id", "canon"])
    exact = mine.where("leads is not null").join(tiles, ["image_id", "leads"]).select("image_id", "pattern", "pid", "leads", "tile", "drawn")
    near = mine.where("joins is not null").select("image_id", "pattern", "pid", F.col("joins").alias("leads")).join(tiles, ["image_id", "leads"]).select("image_id", "pattern", "pid", "leads", "tile", "drawn")
    both = first_flags(exact, 0, flips, channels).select("image_id", "pid", F.lit(True).alias("exact"), "leads", "tile", "flags").unionByName(first_flags(near, limit, flips, channels).select("image_id", "pid", F.lit(False).alias("exact"), "leads", "tile", "flags"))
    options = both.groupBy("image_id", "pid").agg(*[F.max(F.when(F.col("exact") == kind, F.struct("leads", "tile", "flags"))).alias(name) for kind, name in ((True, "own"), (False, "other"))])
    known = stored(patterns.select("image_id", "pattern", "pid").join(options, ["image_id", "pid"]))
    placed = looked_up(cells.select("image_id", "cell", "pattern", "marked"), known, ["image_id", "pattern"])
    own = F.coalesce(F.col("own.leads") <= F.col("cell"), F.lit(False))
    use = F.when(own, F.col("own")).otherwise(F.col("other"))
    out = placed.select("image_id", "cell", "pid", "marked", use["tile"].alias("tile"), use["flags"].alias("flags"), own.alias("exact"))
    return out, tiles.select("image_id", "tile", "drawn"), patterns.select("image_id", "pid", "pattern")


def nearest_kept(tiles: DataFrame, kept: DataFrame, flips: bool, channels: int) -> DataFrame:
    """(image_id, tile, index, flags, error): of each tile (image_id, tile, pattern) the kept one (image_id, index, pattern)
    of the least squared error; of equals the first kept one, then the first mirror image."""

    def argmin(a: Chunk, b: Chunk) -> tuple[np.ndarray, ...]:
        n = len(FLIPS) if flips else 1
        x = a.tiles.reshape(len(a.tiles), -1).astype(np.float64)
        order = np.argsort(b.idx)
        y = np.concatenate([b.tiles[order][:, None, f] for f in FLIPS[:n]], axis=1).reshape(len(b.tiles) * n, -1).astype(np.float64)
        d = (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)  # whole numbers below 2**53
        best = d.argmin(axis=1)
        return a.idx, d[np.arange(len(d)), best].astype(np.int64), b.idx[order][best // n], (best % n).astype(np.int32)

    pairs = met(chunks(tiles.withColumn("idx", F.col("tile")), ["idx", "pattern"], None), chunks(kept.withColumn("idx", F.col("index").cast("long")), ["idx", "pattern"], None), None)
    found = _over_pairs(pairs, channels, argmin, "tile long, error long, index long, flags int")
    best = found.groupBy("image_id", "tile").agg(F.min(F.struct("error", "index", "flags")).alias("b"))
    return best.select("image_id", "tile", "b.index", "b.flags", "b.error")


def compress(cells: DataFrame, target: int, tolerance: float = 0, flips: bool = False, channels: int = 4) -> dict[str, DataFrame]:
    """Tile compression of images (image_id, cell, pattern, marked).

    Returns ``cells`` (image_id, cell, tile: index among the kept tiles, flags, error: squared, of the redrawn
    cell), ``tiles`` (image_id, tile, pattern), and ``summary`` (image_id, original_tiles, marked_tiles, tiles,
    substitutions, squared_error, mse). A target below 1 counts as 1. Cells must be all of an image, once each.
    """
    placed, tiles, patterns = merged_patterns(cells, tolerance, flips, channels)
    placed = stored(placed)
    used = placed.groupBy("image_id", "tile").agg(F.count("*").alias("uses"), F.max(F.col("marked").cast("int")).alias("marked"))
    used = stored(tiles.join(used, ["image_id", "tile"]))
    sizes = used.groupBy("image_id").agg(F.count("*").alias("unique_tiles"), F.sum("marked").alias("marked_tiles"))
    many = sizes.where(F.col("unique_tiles") > max(1, int(target))).select("image_id")
    top = retained(used.join(many, "image_id", "left_semi"), max(1, int(target))).select("image_id", "tile", (F.col("rank") - 1).alias("index"), "drawn")
    whole = used.join(many, "image_id", "left_anti").select("image_id", "tile", F.col("tile").alias("index"), "drawn")
    kept = stored(top.unionByName(whole))
    dropped = used.join(kept.select("image_id", "tile"), ["image_id", "tile"], "left_anti").select("image_id", "tile", F.col("drawn").alias("pattern"))
    near = nearest_kept(dropped, kept.select("image_id", "index", F.col("drawn").alias("pattern")), flips, channels)
    match = kept.select("image_id", "tile", "index", F.lit(0).alias("turn")).unionByName(near.select("image_id", "tile", "index", F.col("flags").alias("turn")))
    found = placed.join(match, ["image_id", "tile"]).select("image_id", "cell", "pid", "exact", F.col("index").alias("tile"), F.col("flags").bitwiseXOR(F.col("turn")).alias("flags"))

    # the error of a redrawn cell depends on its pattern, tile and flags alone
    kinds = found.select("image_id", "pid", "tile", "flags").distinct().join(patterns, ["image_id", "pid"]).join(kept.select("image_id", F.col("index").alias("tile"), "drawn"), ["image_id", "tile"])
    errors = redrawn_errors(kinds, channels).select("image_id", "pid", "tile", "flags", "error")
    out = stored(found.join(errors, ["image_id", "pid", "tile", "flags"]).select("image_id", "cell", "pid", "exact", "tile", "flags", "error"))
    # patterns that joined another tile somewhere count as tiles of the original too
    joined = out.where(~F.col("exact")).groupBy("image_id").agg(F.countDistinct("pid").alias("joined"))
    count = kept.groupBy("image_id").agg(F.count("*").alias("tiles"))
    total = out.groupBy("image_id").agg(F.sum((F.col("error") > 0).cast("long")).alias("substitutions"), F.sum("error").alias("squared_error"), F.count("*").alias("cells"))
    summary = total.join(sizes, "image_id").join(count, "image_id").join(joined, "image_id", "left")
    return {
        "cells": out.select("image_id", "cell", "tile", "flags", "error"),
        "tiles": kept.select("image_id", F.col("index").alias("tile"), F.col("drawn").alias("pattern")),
        "summary": summary.select("image_id", (F.col("unique_tiles") + F.coalesce("joined", F.lit(0))).alias("original_tiles"), F.col("marked_tiles").cast("long").alias("marked_tiles"), "tiles", "substitutions", "squared_error", (F.col("squared_error") / (F.col("cells") * 64 * channels)).alias("mse")),
    }


def redrawn_errors(rows: DataFrame, channels: int) -> DataFrame:
    """``rows`` (pattern, drawn, flags) with the squared ``error`` of the pattern against the mirrored tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (bytes_of(batch.column(c), channels).astype(np.int64) for c in ("pattern", "drawn"))
            turned = b[np.arange(len(b))[:, None], FLIPS[np.asarray(batch.column("flags"))]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(((a - turned) ** 2).sum(axis=(1, 2)))], [*batch.schema.names, "error"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", error long")


def preview(cells: DataFrame, tiles: DataFrame, tiles_x: int, channels: int = 4) -> DataFrame:
    """Pixels of the redrawn images: image_id, x, y, and the channel bytes as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = bytes_of(batch.column("pattern"), channels)
            turned = b[np.arange(len(b))[:, None], FLIPS[np.asarray(batch.column("flags"))]].reshape(-1, channels)
            cell, p = np.repeat(np.asarray(batch.column("cell")), 64), np.tile(np.arange(64), len(b))
            value = pa.ListArray.from_arrays(pa.array(np.arange(len(turned) + 1, dtype=np.int32) * channels), pa.array(turned.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(np.repeat(np.arange(len(b)), 64))), pa.array(cell % tiles_x * 8 + p % 8), pa.array(cell // tiles_x * 8 + p // 8), value], ["image_id", "x", "y", "value"])

    rows = cells.join(tiles, ["image_id", "tile"]).select("image_id", "cell", "flags", "pattern")
    return rows.mapInArrow(run, f"image_id {cells.schema['image_id'].dataType.simpleString()}, x long, y long, value array<int>")
