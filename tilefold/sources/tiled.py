"""Tile maps in JSON or XML: layers of global tile ids, tilesets, flips.

Groups nest to any depth, so a file is walked in Python, a row a layer; everything after that is
relational (``plans.queries.as_of_tilesets`` and ``layer_flatten``).
"""

from __future__ import annotations

import base64
import gzip
import json
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

ID_MASK = 0x0FFFFFFF


@dataclass
class TileMap:
    width: int
    height: int
    tile_width: int
    tile_height: int
    tilesets: list[dict] = field(default_factory=list)
    layers: list[tuple[str, list[int]]] = field(default_factory=list)


def base_name(path: str) -> str:
    """What stands behind the last slash or backslash, in lower case."""
    return re.split(r"[\\/]", path)[-1].lower()


def decode_gids(data, count: int, encoding: str | None = None, compression: str | None = None) -> list[int]:
    """Ids from an array, comma-separated text, or base64 of little-endian words (raw, zlib or gzip)."""
    if isinstance(data, list):
        gids = [int(x) for x in data]
    elif encoding == "csv":
        gids = [int(x) for x in data.split(",") if x.strip()]
    else:
        raw = base64.b64decode(data.strip())
        if compression == "zlib":
            raw = zlib.decompress(raw)
        elif compression == "gzip":
            raw = gzip.decompress(raw)
        elif compression:
            raise ValueError(f"layers compressed by {compression} are not read")
        gids = [x for (x,) in struct.iter_unpack("<I", raw)]
    if len(gids) != count:
        raise ValueError(f"a layer has {len(gids)} cells instead of {count}")
    return gids


def _tileset(get, image: str | None) -> dict:
    number = lambda k, d=0: int(get(k) or d)
    return {"firstgid": number("firstgid", 1), "source": get("source"), "tilewidth": number("tilewidth"), "tileheight": number("tileheight"), "columns": number("columns"), "margin": number("margin"), "spacing": number("spacing"), "tilecount": number("tilecount"), "image": image}


def parse_json(text: str) -> TileMap:
    doc = json.loads(text)
    if doc.get("infinite"):
        raise ValueError("infinite maps are not read")
    out = TileMap(doc["width"], doc["height"], doc["tilewidth"], doc["tileheight"])
    out.tilesets = sorted((_tileset(t.get, t.get("image")) for t in doc.get("tilesets", [])), key=lambda t: t["firstgid"])

    def walk(layers: list[dict], prefix: str) -> None:
        for layer in layers:
            name = prefix + layer.get("name", "")
            if layer["type"] == "group":
                walk(layer.get("layers", []), f"{name}/")
            elif layer["type"] == "tilelayer":
                out.layers.append((name, decode_gids(layer["data"], out.width * out.height, layer.get("encoding"), layer.get("compression"))))

    walk(doc.get("layers", []), "")
    return out


def parse_xml(text: str) -> TileMap:
    root = ET.fromstring(text)
    if root.get("infinite") == "1":
        raise ValueError("infinite maps are not read")
    out = TileMap(*(int(root.get(k)) for k in ("width", "height", "tilewidth", "tileheight")))
    for t in root.findall("tileset"):
        image = t.find("image")
        out.tilesets.append(_tileset(t.get, None if image is None else image.get("source")))
    out.tilesets.sort(key=lambda t: t["firstgid"])

    def walk(element: ET.Element, prefix: str) -> None:
        for child in element:
            name = prefix + (child.get("name") or "")
            if child.tag == "group":
                walk(child, f"{name}/")
            elif child.tag == "layer":
                data = child.find("data")
                tiles = [int(t.get("gid") or 0) for t in data.findall("tile")]
                out.layers.append((name, decode_gids(tiles or data.text or "", out.width * out.height, data.get("encoding"), data.get("compression"))))

    walk(root, "")
    return out


def parse(content: bytes) -> TileMap:
    text = content.decode("utf-8")
    return parse_json(text) if text.lstrip().startswith("{") else parse_xml(text)


LAYERS = "path string, width int, height int, layer string, gids array<bigint>, error string"
TILESETS = "path string, firstgid bigint, source string, image string, tilewidth int, tileheight int, columns int, margin int, spacing int, tilecount int"


def layers(files: DataFrame) -> DataFrame:
    """``path`` and ``content`` to layers; a file that cannot be read has one row with its ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    m = parse(bytes(content))
                    rows += [(path, m.width, m.height, name, gids, None) for name, gids in m.layers]
                except (ValueError, KeyError, ET.ParseError, zlib.error) as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "layer", "gids", "error"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, LAYERS)


def tilesets(files: DataFrame) -> DataFrame:
    """The tilesets of every readable map, by first id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TILESETS.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, *(t[n] for n in names[1:])) for t in parse(bytes(content)).tilesets]
                except (ValueError, KeyError, ET.ParseError, zlib.error):
                    continue  # ``layers`` reports the file
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, TILESETS)
