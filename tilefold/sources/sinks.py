"""File sinks: binary files and PNG images put together from ordered parts.

A file is a set of rows (``file``, ``nth``, ``data``). ``write_files`` sends them through a Spark data
source whose tasks append part after part to a temporary file; files get their names when the
whole job commits, and nothing is left of one that fails. No part needs the whole file: an image
is deflated band by band in parallel tasks, its checksum is combined from those of the bands, and
the task that owns the file only copies.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .png import SIGNATURE, _chunk

#: Modulus of the checksum of zlib streams.
_ADLER = 65521
#: Most entries of an indexed image.
ENTRIES = 256


@dataclass
class Written(WriterCommitMessage):
    """Temporary and final names of the files of a task."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    """Appends the parts of each file as they come; rows must be sorted by file and number."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = self._place()
        own, done, name, sink = f"{root}/_temporary/{uuid.uuid4().hex}", [], None, None
        try:
            for batch in iterator:
                for file, data in zip(batch.column("file").to_pylist(), batch.column("data"), strict=True):
                    if file != name:
                        if sink is not None:
                            sink.close()
                        name, temporary = file, f"{own}/{len(done)}"
                        files.create_dir(own, recursive=True)
                        sink = files.open_output_stream(temporary)
                        done.append((temporary, f"{root}/{name}"))
                    sink.write(data.as_buffer())
        finally:
            if sink is not None:
                sink.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._place()
        files.create_dir(root, recursive=True)
        for message in messages:
            for temporary, final in message.files if message else ():
                files.move(temporary, final)
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._place())

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_temporary")


class FileSink(DataSource):
    """``df.write.format("tilefold_files")`` of rows file, nth, data."""

    @classmethod
    def name(cls) -> str:
        return "tilefold_files"

    def schema(self) -> str:
        return "file string, nth bigint, data binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def write_files(parts: DataFrame, path: str) -> None:
    """Writes files under ``path`` (any store that Arrow can open); files of the same names are replaced."""
    parts.sparkSession.dataSource.register(FileSink)
    rows = parts.select("file", F.col("nth").cast("long").alias("nth"), "data")
    rows.repartition("file").sortWithinPartitions("file", "nth").write.format("tilefold_files").mode("append").save(path)


def hex_files(rows: DataFrame, name: Column) -> DataFrame:
    """Parts of files whose bytes are hex text (``data``), one part each."""
    return rows.select(name.alias("file"), F.lit(0).cast("long").alias("nth"), F.unhex("data").alias("data"))


# ---- images ----


def deflated(bands: DataFrame, channels: int) -> DataFrame:
    """Bands (file, band, width, data: raw lines) as PNG chunks, with the sums of their own checksums (``low``, ``high``, ``n``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for width, data in zip(batch.column("width").to_pylist(), batch.column("data").to_pylist(), strict=True):
                lines = np.frombuffer(data, np.uint8).reshape(-1, width * channels)
                raw = np.zeros((len(lines), width * channels + 1), np.uint8)
                raw[:, 1:] = lines
                packer = zlib.compressobj(wbits=-15)
                body = packer.compress(raw.tobytes()) + packer.flush(zlib.Z_FULL_FLUSH)
                adler = zlib.adler32(raw.tobytes())
                out.append((_chunk(b"IDAT", body), adler & 0xFFFF, adler >> 16, raw.size))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("band"), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["file", "band", "chunk", "low", "high", "n"])

    return bands.select("file", F.col("band").cast("long").alias("band"), F.col("width").cast("int").alias("width"), "data").mapInArrow(run, "file string, band long, chunk binary, low long, high long, n long")


def png_parts(bands: DataFrame, heads: DataFrame, channels: int) -> DataFrame:
    """Parts of PNG files. ``bands``: file, band, width, data; ``heads``: file, width, height, palette, alpha (both null unless indexed).

    ``channels``: 1 for palette indexes, 3 for RGB, 4 for RGBA.
    """
    kind = {1: 3, 3: 2, 4: 6}[channels]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h in batch.to_pylist():
                data = SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", h["width"], h["height"], 8, kind, 0, 0, 0))
                if h["palette"] is not None:
                    data += _chunk(b"PLTE", h["palette"])
                if h["alpha"]:
                    data += _chunk(b"tRNS", h["alpha"])
                out.append(data + _chunk(b"IDAT", b"\x78\x9c"))
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array([0] * len(out), pa.int64()), pa.array(out, pa.binary())], ["file", "nth", "data"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", high << 16 | low)) + _chunk(b"IEND", b"") for low, high in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("nth"), pa.array(out, pa.binary())], ["file", "nth", "data"])

    head = heads.select("file", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "palette", "alpha").mapInArrow(first, "file string, nth long, data binary")
    body = deflated(bands, channels)
    before = F.coalesce(F.sum(F.col("low") - 1).over(Window.partitionBy("file").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % _ADLER
    sums = body.select("file", "band", "low", "high", "n").withColumn("before", before)
    # the sum of sums grows by each band's length times all that came before it
    whole = sums.groupBy("file").agg((F.sum(F.col("low") - 1) + 1).alias("low"), F.sum(F.col("high") + F.col("n") % _ADLER * F.col("before")).alias("high"), (F.max("band") + 2).alias("nth"))
    tail = whole.select("file", "nth", (F.col("low") % _ADLER).alias("low"), (F.col("high") % _ADLER).alias("high")).mapInArrow(last, "file string, nth long, data binary")
    return head.unionByName(body.select("file", (F.col("band") + 1).alias("nth"), F.col("chunk").alias("data"))).unionByName(tail)


def bytes_of(values: Column, width: int = 1) -> Column:
    """A binary of an array of whole numbers, each of ``width`` bytes, the highest first."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2 * width, "0")), ""))


def tile_bands(cells: DataFrame, tiles_x: Column, width: int = 1, tile: int = 8) -> DataFrame:
    """Bands of images from their tiles: file, band (a line of tiles), width, data.

    ``cells``: file, cell, pixels (row by row; packed RGB with ``width`` 3). Cells that are missing are 0.
    """
    rows = cells.withColumn("_x", tiles_x.cast("int")).select("file", F.floor(F.col("cell") / F.col("_x")).alias("band"), "_x", F.struct((F.col("cell") % F.col("_x")).cast("int").alias("x"), "pixels").alias("t"))
    lines = rows.groupBy("file", "band", "_x").agg(F.map_from_entries(F.collect_list("t")).alias("m"))  # a line of tiles
    blank = F.transform(F.sequence(F.lit(1), F.lit(tile * tile)), lambda _: F.lit(0))
    at = F.sequence(F.lit(0), F.col("_x") - 1)
    values = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), lambda y: F.flatten(F.transform(at, lambda x: F.slice(F.coalesce(F.element_at("m", x), blank), y * tile + 1, F.lit(tile))))))
    return lines.select("file", "band", (F.col("_x") * tile).alias("width"), bytes_of(values, width).alias("data"))


def indexed_images(cells: DataFrame, palettes: DataFrame, sizes: DataFrame, transparent_zero: bool = False) -> DataFrame:
    """Parts of PNG files of images of whole tiles: cells (file, cell, pixels: entries), palettes (file, entry, r, g, b), sizes (file, tiles_x, tiles_y).

    Images of more than 256 entries become RGB. With ``transparent_zero`` entry 0 is transparent.
    """
    rgb = F.shiftleft("r", 16) + F.shiftleft("g", 8) + F.col("b")
    tables = palettes.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct(F.col("entry").cast("int"), rgb.cast("int")))).alias("table"), (F.max("entry") + 1).cast("int").alias("entries"))  # one row an image
    known = sizes.join(tables, "file")
    small, large = known.where(F.col("entries") <= ENTRIES), known.where(F.col("entries") > ENTRIES)
    filled = F.transform(F.sequence(F.lit(0), F.col("entries") - 1), lambda i: F.coalesce(F.element_at("table", i), F.lit(0)))
    heads = lambda x, palette, alpha: x.select("file", (F.col("tiles_x") * 8).alias("width"), (F.col("tiles_y") * 8).alias("height"), palette.alias("palette"), alpha.alias("alpha"))
    none = F.lit(None).cast("binary")
    placed = cells.join(small.select("file", "tiles_x"), "file")
    out = png_parts(tile_bands(placed, F.col("tiles_x")), heads(small, bytes_of(filled, 3), F.unhex(F.lit("00")) if transparent_zero else none), 1)
    colored = cells.join(large.select("file", "tiles_x", "table"), "file").withColumn("pixels", F.transform("pixels", lambda v: F.coalesce(F.element_at("table", v.cast("int")), F.lit(0))))
    return out.unionByName(png_parts(tile_bands(colored, F.col("tiles_x"), 3), heads(large, none, none), 3))


def palette_strips(palettes: DataFrame) -> DataFrame:
    """Parts of a PNG file a file: palettes (file, palette, i, r, g, b) as rows of rectangles, 8 high and 8 wide or as wide as 512 allows."""
    rgb = (F.shiftleft("r", 16) + F.shiftleft("g", 8) + F.col("b")).cast("int")
    sizes = palettes.groupBy("file").agg((F.max("i") + 1).alias("colors"), (F.max("palette") + 1).alias("palettes"))
    wide = F.least(F.lit(8), F.ceil(F.lit(512) / F.col("colors"))).cast("int")
    sizes = sizes.withColumn("wide", wide)
    rows = palettes.select("file", "palette", F.struct("i", rgb.alias("rgb")).alias("c")).groupBy("file", "palette").agg(F.array_sort(F.collect_list("c")).alias("c")).join(sizes, "file")
    line = F.flatten(F.transform("c", lambda c: F.transform(F.sequence(F.lit(1), F.col("wide")), lambda _: c["rgb"])))
    bands = rows.select("file", F.col("palette").alias("band"), (F.col("colors") * F.col("wide")).alias("width"), bytes_of(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda _: line)), 3).alias("data"))
    none = F.lit(None).cast("binary")
    heads = sizes.select("file", (F.col("colors") * F.col("wide")).alias("width"), (F.col("palettes") * 8).alias("height"), none.alias("palette"), none.alias("alpha"))
    return png_parts(bands, heads, 3)


def sheets(tiles: DataFrame, across: int = 16) -> DataFrame:
    """Parts of a PNG file a file: tiles (file, tile, pixels: packed RGB) in rows of ``across``; places behind the last are black."""
    sizes = tiles.groupBy("file").agg(F.least(F.lit(across), F.max("tile") + 1).cast("int").alias("tiles_x"), F.ceil((F.max("tile") + 1) / across).cast("int").alias("tiles_y"))
    placed = tiles.join(sizes, "file").select("file", F.col("tile").alias("cell"), "pixels", "tiles_x")
    none = F.lit(None).cast("binary")
    heads = sizes.select("file", (F.col("tiles_x") * 8).alias("width"), (F.col("tiles_y") * 8).alias("height"), none.alias("palette"), none.alias("alpha"))
    return png_parts(tile_bands(placed, F.col("tiles_x"), 3), heads, 3)
