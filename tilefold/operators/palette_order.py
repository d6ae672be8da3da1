"""Order of palettes and of their colours, so that neighbours look alike in a swatch table.

Palettes are few (16 of 256 colours at most), so an image's are one small group; images are parallel.
Every step lowers a sum that is stated, sweep by sweep until no change helps, and does not depend on chance:

1. The colours of each pair of palettes are matched: exchanges lower the sum of distances of matched colours.
2. Palettes are put in a row: turning stretches lowers the sum of those distances of neighbours.
3. The first palette's colours are put in a row in the same way; the next palettes follow by their matching.
4. In each further palette exchanges lower, for each colour, twice the distance to the one above it and that to its neighbours.

The first ``fixed`` colours (a shared colour, or a transparent one) stay where they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WEIGHTS = np.array([2.0, 4.0, 1.0])
#: What the colour above counts against a neighbour in the same palette.
ABOVE = 2
_LEAST = 1e-9


def table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all colours of two palettes."""
    return (((a[:, None, :] - b[None]) ** 2) * WEIGHTS).sum(axis=2)


def matched(d: np.ndarray, fixed: int = 0) -> np.ndarray:
    """For each row of a distance table a column, each used once: no exchange of two rows lowers the sum."""
    n = len(d)
    to = np.arange(n)
    better = True
    while better:
        better = False
        for i in range(fixed, n):
            now = d[i, to[i]] + d[np.arange(n), to]
            then = d[i, to] + d[np.arange(n), to[i]]
            gain = now - then
            gain[: max(fixed, 0)] = 0
            j = int(np.argmax(gain))
            if gain[j] > _LEAST and j != i:
                to[i], to[j] = to[j], to[i]
                better = True
    return to


def in_row(d: np.ndarray, fixed: int = 0) -> list[int]:
    """An order in which turning no stretch behind the first ``fixed`` places shortens the way from place to place."""
    n = len(d)
    path = list(range(n))
    better = True
    while better:
        better = False
        for a in range(fixed, n - 1):
            for b in range(a + 1, n):
                now = (d[path[a - 1], path[a]] if a else 0) + (d[path[b], path[b + 1]] if b + 1 < n else 0)
                then = (d[path[a - 1], path[b]] if a else 0) + (d[path[a], path[b + 1]] if b + 1 < n else 0)
                if then < now - _LEAST:
                    path[a : b + 1] = path[a : b + 1][::-1]
                    better = True
    return path


def unrest(palettes: np.ndarray) -> float:
    """What the last step lowers: twice the distances between rows and those between neighbours, over all palettes."""
    rows = (((palettes[:, 1:] - palettes[:, :-1]) ** 2) * WEIGHTS).sum()
    return float(ABOVE * (((palettes[1:] - palettes[:-1]) ** 2) * WEIGHTS).sum() + rows)


def settled(above: np.ndarray, own: np.ndarray, order: np.ndarray, fixed: int) -> np.ndarray:
    """``order`` of a palette's colours below another one, improved by exchanges."""
    up, side, n = table(own, above), table(own, own), len(own)

    def cost(o: np.ndarray) -> float:
        return ABOVE * up[o, np.arange(n)].sum() + side[o[1:], o[:-1]].sum()

    best = cost(order)
    better = True
    while better:
        better = False
        for i in range(fixed, n - 1):
            for j in range(i + 1, n):
                tried = order.copy()
                tried[i], tried[j] = tried[j], tried[i]
                value = cost(tried)
                if value < best - _LEAST:
                    order, best, better = tried, value, True
    return order


def sort_palettes(palettes: np.ndarray, fixed: int = 0) -> np.ndarray:
    """Palettes x colours x 3, in an order of palettes and colours in which neighbours are alike."""
    p, n, _ = palettes.shape
    palettes = palettes.astype(np.float64)
    to = {(a, b): matched(table(palettes[a], palettes[b]), fixed) for a in range(p) for b in range(p) if a < b}
    to |= {(b, a): np.argsort(x) for (a, b), x in to.items()}
    d = np.zeros((p, p))
    for (a, b), x in to.items():
        d[a, b] = table(palettes[a], palettes[b])[np.arange(n), x].sum()
    row = in_row(d)
    order = np.array(in_row(table(palettes[row[0]], palettes[row[0]]), fixed))
    out = [palettes[row[0]][order]]
    for a, b in zip(row, row[1:], strict=False):
        order = settled(out[-1], palettes[b], to[a, b][order], fixed)
        out.append(palettes[b][order])
    return np.array(out)


def sorted_palettes(rows: DataFrame, fixed: int = 0) -> DataFrame:
    """Palette rows (image_id, palette, i, r, g, b) in their new places. All palettes of an image have as many colours."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["palette", "i"])
        p = group["palette"].nunique()
        out = sort_palettes(group[["r", "g", "b"]].to_numpy().reshape(p, -1, 3), fixed)
        frame = pd.DataFrame(out.reshape(-1, 3).astype(int), columns=["r", "g", "b"])
        frame.insert(0, "i", np.tile(np.arange(out.shape[1]), p))
        frame.insert(0, "palette", np.repeat(np.arange(p), out.shape[1]))
        frame.insert(0, "image_id", group["image_id"].iloc[0])
        return frame

    kind = rows.schema["image_id"].dataType.simpleString()
    return rows.select("image_id", "palette", "i", "r", "g", "b").groupBy("image_id").applyInPandas(run, f"image_id {kind}, palette int, i int, r int, g int, b int")
