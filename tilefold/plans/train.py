"""Stochastic palette training and palette ordering: sequential for one image, parallel over images.

The batch form over all pixels is ``queries.quantize``; this one moves one colour at a time, so
its result depends on the order of the pixels, which a seed fixes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WEIGHTS = np.array([2.0, 4.0, 1.0])
START_RATE, END_RATE = 0.3, 0.03


def nearest(palette: np.ndarray, color: np.ndarray) -> int:
    """Index of the nearest colour; the highest of equals."""
    d = ((palette - color) ** 2 * WEIGHTS).sum(axis=1)
    return int(len(d) - 1 - np.argmin(d[::-1]))


def errors(palette: np.ndarray, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's nearest colour and its distance."""
    d = ((pixels[:, None, :] - palette[None]) ** 2 * WEIGHTS).sum(axis=2)
    index = d.shape[1] - 1 - np.argmin(d[:, ::-1], axis=1)
    return index, d[np.arange(len(d)), index]


def train_palette(pixels: np.ndarray, size: int, seed: int, share: float = 0.1) -> np.ndarray:
    """A palette of ``size`` colours: starts from the mean, splits the colour of the largest error until
    it is full, and after each split trains on a seeded shuffle of ``share`` of the pixels."""
    pixels, rng = np.asarray(pixels, float), np.random.default_rng(seed)
    palette = pixels.mean(axis=0, keepdims=True)
    steps = max(1, int(len(pixels) * share))
    while True:
        order = rng.permutation(len(pixels))[:steps]
        for i, rate in zip(order, np.geomspace(START_RATE, END_RATE, len(order)), strict=True):
            k = nearest(palette, pixels[i])
            palette[k] += rate * (pixels[i] - palette[k])
        if len(palette) >= size:
            return np.floor(palette + 0.5)
        index, error = errors(palette, pixels)
        worst = int(np.argmax(np.bincount(index, weights=error, minlength=len(palette))))
        own = np.flatnonzero(index == worst)
        palette = np.vstack([palette, pixels[own[int(np.argmax(error[own]))]]])


def train(pixels: DataFrame, size: int, seed: int = 1, share: float = 0.1) -> DataFrame:
    """A palette for each image: (image_id, i, r, g, b). ``pixels``: image_id, p (order), r, g, b."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p")
        palette = order(train_palette(rows[["r", "g", "b"]].to_numpy(), size, seed, share))
        out = pd.DataFrame(palette.astype(int), columns=["r", "g", "b"])
        out.insert(0, "i", range(len(out)))
        out.insert(0, "image_id", rows["image_id"].iloc[0])
        return out

    kind = pixels.schema["image_id"].dataType.simpleString()
    return pixels.select("image_id", "p", "r", "g", "b").groupBy("image_id").applyInPandas(run, f"image_id {kind}, i int, r int, g int, b int")


def order(palette: np.ndarray) -> np.ndarray:
    """Colours so that neighbours are alike: from the darkest on, then reversing stretches while the path gets shorter."""
    n = len(palette)
    d = np.sqrt(((palette[:, None] - palette[None]) ** 2 * WEIGHTS).sum(axis=2))
    path, rest = [int(np.argmin(palette @ WEIGHTS))], set(range(n))
    rest.discard(path[0])
    while rest:
        path.append(min(rest, key=lambda k: (d[path[-1], k], k)))
        rest.discard(path[-1])
    better = True
    while better:
        better = False
        for a in range(1, n - 1):
            for b in range(a + 1, n):
                now = d[path[a - 1], path[a]] + (d[path[b], path[b + 1]] if b + 1 < n else 0)
                then = d[path[a - 1], path[b]] + (d[path[a], path[b + 1]] if b + 1 < n else 0)
                if then < now - 1e-9:
                    path[a : b + 1] = path[a : b + 1][::-1]
                    better = True
    return palette[path]
