"""Colour arithmetic as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CHANNEL_STEP


def half_up(x: Column) -> Column:
    """Rounded, halves towards +infinity."""
    return F.when(x - F.floor(x) >= 0.5, F.floor(x) + 1).otherwise(F.floor(x))


def clamp_byte(x: Column) -> Column:
    """0 below 0 and for NaN, 255 above 255, else rounded with ties to even."""
    return F.when(F.isnan(x) | ~(x > 0), 0).when(x > 255, 255).otherwise(F.rint(x)).cast("int")


def reduce_channel(value: Column, bits: int, mega_drive: bool = False) -> Column:
    """A channel of ``bits`` bits; the Mega Drive then has steps of 0x22."""
    rounded = half_up(half_up(value / CHANNEL_STEP[bits]) * CHANNEL_STEP[bits])
    return half_up(rounded / 255 * 7) * 0x22 if mega_drive else rounded


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """2 dr^2 + 4 dg^2 + db^2."""
    r, g, b_ = (x - y for x, y in zip(a, b, strict=True))
    return 2 * r * r + 4 * g * g + b_ * b_


def luma(r: Column, g: Column, b: Column) -> Column:
    return 299 * r + 587 * g + 114 * b


def rgb555(r: Column, g: Column, b: Column) -> Column:
    """Five bits a channel, truncated, red lowest."""
    return F.shiftright(r, 3).bitwiseOR(F.shiftleft(F.shiftright(g, 3), 5)).bitwiseOR(F.shiftleft(F.shiftright(b, 3), 10))


def expand5(value: Column) -> Column:
    """Eight bits of five, by repeating the upper ones."""
    return F.shiftleft(value, 3).bitwiseOR(F.shiftright(value, 2))


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def parse_hex(text: Column) -> Column:
    """(r, g, b) of ``#rrggbb``."""
    return F.struct(*[F.conv(F.substring(text, 2 + 2 * i, 2), 16, 10).cast("int").alias(c) for i, c in enumerate("rgb")])


def literal_colors(colors: Sequence[tuple[int, int, int]]) -> Column:
    """A constant array of colours."""
    return F.array(*[F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"), F.lit(i).alias("i")) for i, (r, g, b) in enumerate(colors)])


def nearest(r: Column, g: Column, b: Column, palette: Column, highest_wins: bool = True) -> Column:
    """Struct (d, i) of the nearest palette colour; the highest index wins a tie, or else the lowest."""

    def entry(c: Column) -> Column:
        d = distance((r, g, b), (c["r"], c["g"], c["b"]))
        return F.struct(d.cast("long").alias("d"), (-c["i"] if highest_wins else c["i"]).alias("k"))

    best = F.array_min(F.transform(palette, entry))
    return F.struct(best["d"].alias("d"), F.abs(best["k"]).alias("i"))


def _linear(v: Column) -> Column:
    v = v / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


# Linear sRGB to XYZ; to the cone response of OKLab; and from that to OKLab.
_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
_CONES = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
_OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def _times(matrix, vector: Sequence[Column]) -> list[Column]:
    return [sum((m * v for m, v in zip(row[1:], vector[1:], strict=True)), row[0] * vector[0]) for row in matrix]


def color_fit(model: str, r: Column, g: Column, b: Column, chroma: float = 1.0) -> list[Column]:
    """Coordinates in which 2u^2 + 4v^2 + w^2 is the model's own distance."""
    lin = [_linear(c.cast("double")) for c in (r, g, b)]
    if model == "linear":
        return [c * 255 for c in lin]
    weights = (1.0, 1.0, 1.0)
    if model == "xyz":
        out = [c * 255 for c in _times(_XYZ, lin)]
    elif model == "cielab":
        x, y, z = _times(_XYZ, lin)
        fx, fy, fz = (F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116) for t in (x / 0.95047, y, z / 1.08883))
        out, weights = [2.55 * (116 * fy - 16), 2.55 * 500 * (fx - fy), 2.55 * 200 * (fy - fz)], (1.0, chroma, chroma)
    elif model == "oklab":
        out, weights = [255 * c for c in _times(_OKLAB, [F.cbrt(c) for c in _times(_CONES, lin)])], (1.0, chroma, chroma)
    else:
        raise ValueError(f"no colour model {model}")
    return [c * (w / s) ** 0.5 for c, w, s in zip(out, weights, (2, 4, 1), strict=True)]
