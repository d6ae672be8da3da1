"""Source-text and binary outputs of attribute tables and converted graphics."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs


def label_of(name: str) -> str:
    """An identifier made of a file's name."""
    identifier = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return ("_" if identifier[:1].isdigit() else "") + identifier + "_attr"


def pack_nes(palettes: list[int], blocks_x: int, blocks_y: int) -> tuple[bytes, int, int]:
    """2x2 blocks a byte, two bits each, top left lowest; blocks beyond the edge are 0."""
    width, height = (blocks_x + 1) // 2, (blocks_y + 1) // 2
    out = bytearray(width * height)
    for i, p in enumerate(palettes):
        y, x = divmod(i, blocks_x)
        out[y // 2 * width + x // 2] |= (p & 3) << (y % 2 * 4 + x % 2 * 2)
    return bytes(out), width, height


def pack_mmc5(palettes: list[int]) -> bytes:
    """A byte a tile: the palette in bits 6 and 7."""
    return bytes((p & 3) << 6 for p in palettes)


def pack_gbc(palettes: list[int], priority: list[int] | None = None) -> bytes:
    """A byte a tile: the palette in bits 0 to 2, priority in bit 7."""
    return bytes((p & 7) | (128 if priority and priority[i] else 0) for i, p in enumerate(palettes))


@dataclass(frozen=True)
class Format:
    """How a table of bytes is written: ``{size}``, ``{kind}``, ``{source}``, ``{packed}`` and ``{label}`` are filled into its lines."""

    head: tuple[str, ...]
    byte: str = "0x{:02x}"
    row: str = "\t{}"
    between: str = "\n"
    tail: tuple[str, ...] = ()
    codec: str = ""
    suffix: str = ""


_C = {"between": ",\n", "tail": ("}};",)}
_C_OPEN = "const unsigned char {label}[{packed}]={{"
_DECLARE = "// Declare it where it's used: extern const unsigned char {label}[{packed}];"


def _compressed(title: str, suffix: str, unpack: str = "") -> Format:
    """A C array of a codec's stream; ``suffix`` is also the codec's name."""
    about = ("// {size} {kind}, " + title + " packed to {packed}, from {source}", *([f"// Unpack with {unpack}"] if unpack else []))
    return Format((*about, _DECLARE, _C_OPEN), codec=suffix, suffix=f"_{suffix.removeprefix('nes-')}", **_C)


# The lines of the text formats, as the assemblers and C libraries of the consoles read them.
NES_FORMATS = {
    "asm-byte": Format(("; {size} {kind}, from {source}", "{label}:"), byte="${:02x}", row="\t.byte {}"),
    "asm-db": Format(("; {size} {kind}, from {source}", "{label}:"), byte="${:02x}", row="\t.db {}"),
    "c": Format(("// {size} {kind}, from {source}", _DECLARE, _C_OPEN), **_C),
    "c-rle": _compressed("NESlib RLE", "nes-rle"),
}
GBC_FORMATS = {
    "c": NES_FORMATS["c"],
    "c-rle": _compressed("GBDK RLE", "rle", "rle_init() then rle_decompress() (gbdk/rledecompress.h)"),
    "c-gb": _compressed("GBDK GB (GBTD)", "gb", "gb_decompress() (gb/gbdecompress.h)"),
    "c-zx0": _compressed("GBDK ZX0", "zx0", "zx0_decompress() (gbdk/zx0decompress.h)"),
    "asm-gbdk": Format(("; {size} {kind}, from {source}", "; Declare it in C: extern const unsigned char {label}[{size}];", "\t.module {label}", "\t.area _CODE", "_{label}::"), row="\t.db {}"),
    "asm-rgbds": Format(("; {size} {kind}, from {source}", "{label}:"), byte="${:02x}", row="\tdb {}"),
}
PACKED_ROW = 16


def emit(form: Format, data: bytes, width: int, kind: str, label: str, source: str) -> str:
    """A table as text: the format's lines around a line for each row of ``width`` bytes (``PACKED_ROW`` for a compressed one)."""
    size = len(data)
    if form.codec:
        data, width = codecs.rle_nes(data) if form.codec == "nes-rle" else codecs.CODECS[form.codec](data), PACKED_ROW
    named = {"size": size, "kind": kind, "source": source, "packed": len(data), "label": label + form.suffix}
    cells = [form.byte.format(b) for b in data]
    body = form.between.join(form.row.format(",".join(cells[i : i + width])) for i in range(0, len(cells), width))
    return "\n".join([line.format(**named) for line in form.head] + [body] + [line.format(**named) for line in form.tail] + [""])


def _form(forms: dict[str, Format], name: str) -> Format:
    if name not in forms:
        raise ValueError(f"no attribute format {name}")
    return forms[name]


def nes_text(data: bytes, width: int, height: int, kind: str, label: str, source: str, what: str = "attribute") -> str:
    """Attribute bytes in one of ``NES_FORMATS``."""
    return emit(_form(NES_FORMATS, kind), data, width, f"{what} bytes ({width}x{height})", label, source)


def gbc_text(data: bytes, width: int, kind: str, label: str, source: str) -> str:
    """Attribute bytes in one of ``GBC_FORMATS``."""
    return emit(_form(GBC_FORMATS, kind), data, width, f"GBC BG attributes ({width}x{len(data) // width} tiles)", label, source)


def text_files(tables: DataFrame, form: Format, kind: str) -> DataFrame:
    """``label`` and ``text`` of each table (label, source, width, data as binary)."""

    def write(label: pd.Series, source: pd.Series, width: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([emit(form, bytes(d), int(w), kind, name, s) for name, s, w, d in zip(label, source, width, data, strict=True)], dtype=object)

    return tables.select("label", F.pandas_udf(write, "string")("label", "source", "width", "data").alias("text"))
