"""Work in windows around every pixel: equalisation, and blurs as by a lens."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterfold.functions import kernels
from rasterfold.operators.bands import BAND, over_bands, spread_out


def ranked(levels: np.ndarray, rows: range, half_y: int, half_x: int, clip: int | None) -> np.ndarray:
    """The new level of each pixel of those rows: its rank in its window, from moving histograms.

    Each column keeps a histogram of the window's lines, changed by one line in and one out from row
    to row; differences of their running sums along the row are the windows' histograms. What they
    have above clip is dealt evenly over all levels. A window of one level leaves it.
    """
    high, wide = levels.shape
    columns = np.zeros((wide, 256), np.int64)
    at = np.arange(wide)
    right, left = np.minimum(wide - 1, at + half_x), at - half_x - 1
    out = np.zeros((len(rows), wide), np.int64)
    begin = end = max(0, rows.start - half_y)
    for k, y in enumerate(rows):
        while end <= min(high - 1, y + half_y):
            columns[at, levels[end]] += 1
            end += 1
        while begin < y - half_y:
            columns[at, levels[begin]] -= 1
            begin += 1
        sums = columns.cumsum(0)
        window = sums[right]
        window[left >= 0] -= sums[left[left >= 0]]
        total = window.sum(1)
        if clip is not None:
            over = np.maximum(window - clip, 0).sum(1)
            window = np.minimum(window, clip) + (over // 256)[:, None] + (np.arange(256) < (over % 256)[:, None])
        some = window > 0
        last = 255 - some[:, ::-1].argmax(1)
        step = (total - window[at, last]) / 255.0
        own = levels[y]
        before = window.cumsum(1)[at, own] - window[at, own]
        plain = (some.sum(1) <= 1) | (step <= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[k] = np.where(plain, own, np.minimum(255, np.floor((step / 2 + before) / step)))
    return out


def equalize_sliding(px: DataFrame, tiles: int, clip: int | None = None, level: str = "l", band: int = BAND) -> DataFrame:
    """image_id, y, x, level and its equal, new: each pixel's level by its rank in the window around it.

    A window has the size of one of tiles x tiles tiles of its image, and ends at the image's edges.
    Images are dealt in bands with the lines that their windows reach.
    """
    size = F.greatest(F.lit(1), F.floor(F.col("height") / F.least(F.lit(tiles), F.col("height"))))
    half = F.floor(size / 2).cast("int")

    def equalized(planes: dict[str, np.ndarray], top: int, first: int, height: int) -> dict[str, object]:
        levels = planes[level].astype(np.int64)
        width = levels.shape[1]
        half_y, half_x = (max(1, n // min(tiles, n)) // 2 for n in (height, width))
        rows = range(first - top, min(first - top + band, len(levels)))
        new = ranked(levels, rows, half_y, half_x, clip)
        y = np.arange(first, first + len(rows), dtype=np.int32)
        return {"y": y, level: list(levels[rows.start : rows.stop].astype(np.int32)), "new": list(new.astype(np.int32))}

    lines = over_bands(px, [level], half, half, equalized, f"y int, {level} array<int>, new array<int>", band)
    return spread_out(lines, level, "new")


def bokeh_blur(px: DataFrame, radius: int, components: int = 2, gamma: float = 3.0, channels: tuple[str, ...] = ("r", "g", "b"), alpha: str | None = None, band: int = BAND) -> DataFrame:
    """image_id, y, x and channels, blurred as by a lens: a disk of that radius, made of one to six complex kernels.

    Channels are blurred as powers of gamma, so that lights stay bright, alpha as it is; edges are
    repeated. Each kernel runs along lines and then across them, so the cost of a pixel grows with
    the radius, not with the disk.
    """
    named = [*channels, *([alpha] if alpha else [])]
    kernel = [(np.array(taps), weight) for taps, weight in kernels.bokeh(radius, components)]

    def blurred(planes: dict[str, np.ndarray], top: int, first: int, height: int) -> dict[str, object]:
        y = np.arange(first, min(first + band, top + len(planes[named[0]])))
        around = np.clip(y[:, None] + np.arange(-radius, radius + 1), 0, height - 1) - top
        out: dict[str, object] = {"y": y.astype(np.int32)}
        for c in named:
            power = 1.0 if c == alpha else gamma
            light = np.pad((planes[c] / 255) ** power, ((0, 0), (radius, radius)), "edge")
            total = np.zeros((len(y), planes[c].shape[1]))
            for taps, weight in kernel:
                across = sliding_window_view(light, 2 * radius + 1, 1) @ taps
                total += (weight * np.einsum("ykx,k->yx", across[around], taps)).real
            level = np.clip(total, 0, 1) ** (1 / power) * 255
            out[c] = list(np.clip(np.floor(np.round(level, 5) + 0.5), 0, 255).astype(np.int32))
        return out

    lines = over_bands(px, named, radius, radius, blurred, "y int, " + ", ".join(f"{c} array<int>" for c in named), band)
    return spread_out(lines, *named)
