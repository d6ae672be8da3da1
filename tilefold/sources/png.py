"""PNG files: readers of indexed and true-colour images, and a writer of indexed ones, over binary columns.

Spark's own image reader loses palette indexes, so files come through ``binaryFile`` and are
decoded in batches; each file is one row, so files are read in parallel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"


@dataclass
class IndexedImage:
    width: int
    height: int
    palette: bytes  # RGB triplets
    alpha: bytes | None
    indexes: np.ndarray  # height x width


def _unfiltered(raw: bytes, height: int, stride: int, step: int = 1) -> np.ndarray:
    """Scan lines without their filters; ``step`` is the bytes of a pixel (1 for indexed images)."""
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int64)
    for y in range(height):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int64)
        if kind == 0:
            row = line
        elif kind == 1:
            row = np.cumsum(line.reshape(-1, step), axis=0).reshape(-1) % 256
        elif kind == 2:
            row = (line + above) % 256
        elif kind in (3, 4):
            row = np.zeros(stride, np.int64)
            for x in range(stride):
                up = int(above[x])
                left, corner = (int(row[x - step]), int(above[x - step])) if x >= step else (0, 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    base = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(base - v))  # the first of equals
                row[x] = (int(line[x]) + guess) % 256
        else:
            raise ValueError(f"filter {kind} does not exist")
        out[y] = above = row
    return out


def _parts(data: bytes) -> tuple[tuple, dict[bytes, bytes]]:
    """The header's fields and the other chunks that are read, by kind; checksums are not looked at."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, found, ended = len(SIGNATURE), {}, False
    while at + 8 <= len(data) and not ended:
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("the file is cut off")
        found.setdefault(kind, []).append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if b"IHDR" not in found:
        raise ValueError("there is no header")
    return struct.unpack(">IIBBBBB", found[b"IHDR"][-1]), {kind: b"".join(bodies) if kind == b"IDAT" else bodies[-1] for kind, bodies in found.items()}


def _lines(parts: dict[bytes, bytes], height: int, stride: int, step: int = 1) -> np.ndarray:
    raw = zlib.decompress(parts.get(b"IDAT", b""))
    if len(raw) < height * (stride + 1):
        raise ValueError("the pixels are cut off")
    return _unfiltered(raw, height, stride, step)


def decode(data: bytes) -> IndexedImage:
    """Reads an indexed PNG."""
    (width, height, depth, color, _, _, interlace), parts = _parts(data)
    if color != 3 or depth not in (1, 2, 4, 8) or interlace:
        raise ValueError("only indexed images of 1, 2, 4 or 8 bits without interlace are read")
    if b"PLTE" not in parts:
        raise ValueError("there is no palette")
    rows = _lines(parts, height, (width * depth + 7) // 8)
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = np.packbits(np.concatenate([np.zeros((*bits.shape[:2], 8 - depth), np.uint8), bits], axis=2), axis=2)[..., 0]
    return IndexedImage(width, height, parts[b"PLTE"], parts.get(b"tRNS"), rows[:, :width])


#: Channels of the colour types of true-colour and grey images.
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_rgba(data: bytes) -> np.ndarray:
    """Raw colours of any PNG without interlace: height x width x (r, g, b, a), no colour management, alpha not multiplied in.

    True-colour and grey images have 8 bits a channel; their transparent colour has alpha 0. An indexed pixel without an entry is black.
    """
    (width, height, depth, color, _, _, interlace), parts = _parts(data)
    if color == 3:
        image = decode(data)
        table = np.zeros((256, 4), np.uint8)
        table[:, 3] = 255
        entries = np.frombuffer(image.palette, np.uint8)[: len(image.palette) // 3 * 3].reshape(-1, 3)
        table[: len(entries), :3] = entries
        table[: len(image.alpha or b""), 3] = np.frombuffer(image.alpha or b"", np.uint8)
        return table[image.indexes]
    if color not in _CHANNELS or depth != 8 or interlace:
        raise ValueError("only images of 8 bits a channel without interlace are read")
    n = _CHANNELS[color]
    own = _lines(parts, height, width * n, n).reshape(height, width, n)
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = own[..., :3] if n >= 3 else own[..., :1]
    if n in (2, 4):
        out[..., 3] = own[..., -1]
    elif b"tRNS" in parts:
        key = np.frombuffer(parts[b"tRNS"], ">u2")
        out[..., 3][(own == key).all(axis=2)] = 0
    return out


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(image: IndexedImage) -> bytes:
    """An 8-bit indexed PNG with 1 to 256 entries."""
    entries = len(image.palette) // 3
    if not 1 <= entries <= 256:
        raise ValueError("an indexed PNG has 1 to 256 colours")
    lines = np.zeros((image.height, image.width + 1), np.uint8)
    lines[:, 1:] = image.indexes
    head = struct.pack(">IIBBBBB", image.width, image.height, 8, 3, 0, 0, 0)
    trns = _chunk(b"tRNS", image.alpha) if image.alpha is not None else b""
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"PLTE", image.palette) + trns + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


IMAGES = "path string, width int, height int, palette binary, alpha binary, indexes binary, error string"


def decode_files(files: DataFrame) -> DataFrame:
    """``path`` and ``content`` to images; a file that cannot be read has its ``error`` instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    i = decode(bytes(content))
                    rows.append((path, i.width, i.height, i.palette, i.alpha, i.indexes.tobytes(), None))
                except (ValueError, zlib.error, struct.error) as e:
                    rows.append((path, None, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["path", "width", "height", "palette", "alpha", "indexes", "error"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, IMAGES)


COLORS = "path string, width int, height int, rgba binary, error string"


def decode_color_files(files: DataFrame) -> DataFrame:
    """``path`` and ``content`` to raw colours, whatever the colour type; a file that cannot be read has its ``error`` instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    image = decode_rgba(bytes(content))
                    rows.append((path, image.shape[1], image.shape[0], image.tobytes(), None))
                except (ValueError, zlib.error, struct.error) as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "rgba", "error"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, COLORS)


def color_pixels(images: DataFrame) -> DataFrame:
    """Images of raw colours to rows (path, x, y, r, g, b, a), as ``plans.convert`` takes them."""
    at = F.explode(F.sequence(F.lit(0), (F.col("width") * F.col("height") - 1).cast("int"))).alias("p")
    rows = images.where("error is null and width * height > 0").select("path", "width", "rgba", at)
    channels = [F.conv(F.hex(F.substring("rgba", F.col("p") * 4 + i + 1, F.lit(1))), 16, 10).cast("int").alias(c) for i, c in enumerate("rgba")]
    return rows.select("path", (F.col("p") % F.col("width")).alias("x"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), *channels)


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path))


def pixels(images: DataFrame) -> DataFrame:
    """Images to rows (path, x, y, idx, r, g, b, a): a dictionary decode; a missing entry is 0, alpha 255."""
    byte = lambda column, at: F.coalesce(F.conv(F.hex(F.substring(column, at + 1, 1)), 16, 10).cast("int"), F.lit(0))
    rows = images.where("error is null").select("path", "width", "palette", "alpha", "indexes", F.explode(F.sequence(F.lit(0), F.length("indexes") - 1)).alias("p"))
    rows = rows.withColumn("idx", byte(F.col("indexes"), F.col("p")))
    alpha = F.when(F.col("alpha").isNull() | (F.col("idx") >= F.length("alpha")), 255).otherwise(byte(F.col("alpha"), F.col("idx")))
    channels = [byte(F.col("palette"), F.col("idx") * 3 + i).alias(c) for i, c in enumerate("rgb")]
    return rows.select("path", (F.col("p") % F.col("width")).alias("x"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), "idx", *channels, alpha.alias("a"))
