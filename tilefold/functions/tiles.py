"""Tile arithmetic as Spark columns. A tile is an array of 64 values, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let


def flipped(tile: Column, horizontal: bool, vertical: bool) -> Column:
    """The tile mirrored."""
    mask = (7 if horizontal else 0) + (56 if vertical else 0)
    return let(tile, lambda t: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.get(t, p.bitwiseXOR(F.lit(mask))))) if mask else tile


def plane_rows(tile: Column, plane: int) -> Column:
    """Eight bytes of a bit plane; bit 7 is the leftmost pixel."""

    def row(t: Column, y: Column) -> Column:
        bits = [F.shiftleft(F.shiftright(F.get(t, y * 8 + x), plane).bitwiseAND(F.lit(1)), 7 - x) for x in range(8)]
        out = bits[0]
        for b in bits[1:]:
            out = out.bitwiseOR(b)
        return out

    return let(tile, lambda t: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: row(t, y)))


def pack_sequential(tile: Column) -> Column:
    """Two planes one after the other (16 bytes)."""
    return F.concat(plane_rows(tile, 0), plane_rows(tile, 1))


def pack_paired(tile: Column, bpp: int) -> Column:
    """Planes in pairs that alternate row by row; a last plane without a partner stands alone."""
    parts = []
    for plane in range(0, bpp, 2):
        low = plane_rows(tile, plane)
        parts.append(F.flatten(F.zip_with(low, plane_rows(tile, plane + 1), lambda a, b: F.array(a, b))) if plane + 1 < bpp else low)
    return F.concat(*parts)


def hex_bytes(values: Column, separator: str = "") -> Column:
    return F.array_join(F.transform(values, lambda b: F.lower(F.lpad(F.hex(b), 2, "0"))), separator)


def attribute_byte(palette: Column, bank: Column, horizontal: Column, vertical: Column) -> Column:
    """Palette in bits 0-2, bank in 3, flips in 5 and 6."""
    return palette.bitwiseAND(F.lit(7)) + F.shiftleft(bank, 3) + F.shiftleft(horizontal, 5) + F.shiftleft(vertical, 6)
