"""Fixed tables of the console targets."""

from __future__ import annotations

# The 2C02G palette of the quantizer, 0xRRGGBB for PPU colours $00-$3F.
QUANTIZER_NES = (
    0x575757, 0x000C8E, 0x0800A6, 0x340096, 0x550061, 0x630015, 0x5A0000, 0x3C0E00, 0x112800, 0x003B00, 0x004200, 0x003A05, 0x002652, 0x000000, 0x000000, 0x000000,
    0xA5A5A5, 0x0041D9, 0x2F1EFF, 0x6704F2, 0x9400B4, 0xAA0057, 0xA31800, 0x803900, 0x4B5B00, 0x137600, 0x008100, 0x007923, 0x006288, 0x000000, 0x000000, 0x000000,
    0xFFFFFF, 0x4A9FFF, 0x797EFF, 0xAF63FF, 0xDD55FF, 0xF757C2, 0xF76A63, 0xDC8810, 0xAEA900, 0x78C400, 0x4AD211, 0x2FCF64, 0x2FBDC4, 0x414141, 0x000000, 0x000000,
    0xFFFFFF, 0xB9DDFF, 0xCAD1FF, 0xDEC6FF, 0xF0C0FF, 0xFCC0EE, 0xFDC6CA, 0xF5D0AA, 0xE4DD95, 0xD0E892, 0xBDEEA2, 0xB2EEC0, 0xB0E8E3, 0xB3B3B3, 0x000000, 0x000000,
)
# The palgen palette of the hardware conversion, in the same order.
CONVERSION_NES = (
    0x464646, 0x00065A, 0x000678, 0x020673, 0x35034C, 0x57000E, 0x5A0000, 0x410000, 0x120200, 0x001400, 0x001E00, 0x001E00, 0x001521, 0x000000, 0x000000, 0x000000,
    0x9D9D9D, 0x004AB9, 0x0530E1, 0x5718DA, 0x9F07A7, 0xCC0255, 0xCF0B00, 0xA42300, 0x5C3F00, 0x0B5800, 0x006600, 0x006713, 0x005E6E, 0x000000, 0x000000, 0x000000,
    0xFEFFFF, 0x1F9EFF, 0x5376FF, 0x9865FF, 0xFC67FF, 0xFF6CB3, 0xFF7466, 0xFF8014, 0xC49A00, 0x71B300, 0x28C421, 0x00C874, 0x00BFD0, 0x2B2B2B, 0x000000, 0x000000,
    0xFEFFFF, 0x9ED5FF, 0xAFC0FF, 0xD0B8FF, 0xFEBFFF, 0xFFC0E0, 0xFFC3BD, 0xFFCA9C, 0xE7D58B, 0xC5DF8E, 0xA6E6A3, 0x94E8C5, 0x92E4EB, 0xA7A7A7, 0x000000, 0x000000,
)
# PPU colours that matching leaves out, and those that win ties.
NES_EXCLUDED = (0x0D, 0x0E, 0x1E, 0x2E, 0x3E, 0x0F, 0x1F, 0x2F, 0x3F)
NES_CANONICAL = (0x0F, 0x30)
# Shades of the monochrome handheld, lightest first.
DMG_SHADES = (0xFFFFFF, 0xAAAAAA, 0x555555, 0x000000)
# Rounded step of an n-bit channel (index n).
CHANNEL_STEP = (0.0, 255.0, 85.0, 36.42857, 17.0, 8.22581, 4.04762, 2.00787, 1.0)
# 2x2 ordered dither matrices [x & 1][y & 1].
DITHER_PATTERNS = (((0, 2), (3, 1)), ((0, 3), (1, 2)), ((0, 1), (3, 2)), ((0, 1), (1, 0)), ((0, 1), (0, 1)), ((0, 0), (1, 1)))
# Limits of the conversion targets.
TARGETS = {
    "nes": {"block": 16, "palettes": 4, "colors": 4, "tiles": 256, "flips": False},
    "gb": {"block": 8, "palettes": 1, "colors": 4, "tiles": 256, "flips": False},
    "gbc": {"block": 8, "palettes": 8, "colors": 4, "tiles": 512, "flips": True},
}


def rgb_table(colors: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(r, g, b) of each entry."""
    return [(v >> 16, v >> 8 & 255, v & 255) for v in colors]


def nes_candidates(preferred: int | None = None) -> list[int]:
    """PPU colours in the order in which the first of equal distance wins."""
    rest = [i for i in range(64) if i not in NES_EXCLUDED and i not in NES_CANONICAL]
    return ([] if preferred is None else [preferred]) + [*NES_CANONICAL, *rest]


#: A small palette set for queries: four palettes of four colours.
PALETTES = [[((p * 64 + c * 21) % 256, c * 85 % 256, (p * 85 + c * 40) % 256) for c in range(4)] for p in range(4)]
