"""The part of an image that matters most, in the shape that is asked for."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterfold.operators.bands import over_bands
from rasterfold.operators.geometry import resize
from rasterfold.operators.pixels import sized, with_own

#: Sides of the image that is looked at and of the grid that it is summed up to.
ANALYSIS, GRID = 256, 64
#: The colour of skin, the distance from it that counts, and the weights of detail, saturation, skin and of what is left outside.
SKIN, NEAR, WEIGHTS, OUTSIDE = (0.78, 0.57, 0.44), 0.12, (1.0, 0.3, 1.5), 0.5


def importance(planes: dict[str, np.ndarray], weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """How much each pixel matters: local contrast, saturation and nearness to the colour of skin, by its alpha."""
    r, g, b, a = (planes[c] / 255 for c in "rgba")
    light = 0.2126 * r + 0.7152 * g + 0.0722 * b
    wide = np.pad(light, 1, "edge")
    detail = np.minimum(1, np.abs(4 * light - wide[:-2, 1:-1] - wide[2:, 1:-1] - wide[1:-1, :-2] - wide[1:-1, 2:]))
    most, least = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    both = most + least
    with np.errstate(divide="ignore", invalid="ignore"):
        saturation = np.where((most > least) & (light > 0.05) & (light < 0.95), (most - least) / np.where(both > 1, 2 - both, both), 0)
        size = np.sqrt(r * r + g * g + b * b)
        skin = np.array(SKIN) / math.sqrt(sum(v * v for v in SKIN))
        away = np.sqrt(sum((c / size - s) ** 2 for c, s in zip((r, g, b), skin, strict=True)))
        skin_like = np.where((size > 0) & (light > 0.2) & (light < 0.95), np.maximum(0, 1 - away / NEAR), 0)
    return (weights[0] * detail + weights[1] * saturation + weights[2] * skin_like) * a


def _placement(u: np.ndarray, v: np.ndarray, thirds: bool) -> np.ndarray:
    """What a place (0 to 1) in a window is worth: more near the middle and the lines of thirds, less at the edge."""
    x, y = np.abs(2 * u - 1), np.abs(2 * v - 1)
    worth = 1 - 0.5 * np.sqrt((x * x + y * y) / 2)
    if thirds:
        worth = worth * (1 + 0.5 * sum(np.maximum(0, 1 - np.abs(p - 1 / 3) * 6) for p in (x, y)))
    edge = np.maximum(x, y)
    return np.where(edge > 0.8, worth * np.maximum(0, (1 - edge) / 0.2), worth)


def best_window(cells: np.ndarray, source: tuple[int, int], wanted: tuple[int, int], min_scale: float = 1.0, outside: float = OUTSIDE, thirds: bool = True) -> tuple[int, int, int, int]:
    """x, y, width, height of the window of the wanted shape whose cells matter most for its size.

    Windows are of the largest size that fits, or in steps of about a tenth down to min_scale of
    it; the one in the middle and those at every cell are scored. Of equal scores the one nearer to
    the middle stays; where nothing matters, the middle does.
    """
    (sw, sh), (gh, gw) = source, cells.shape
    shape = wanted[0] / wanted[1]
    base_w = min(sw, sh * shape)
    base_h = base_w / shape
    fit = lambda n, most: min(max(round(n), 1), most)
    w, h = fit(base_w, sw), fit(base_h, sh)
    best = ((sw - w) // 2, (sh - h) // 2, w, h)
    total = float(cells.sum())
    if total <= 1e-12:
        return best
    score_of_best, distance_of_best = -math.inf, math.inf
    steps = max(1, round((1 - min_scale) / 0.1)) + 1
    cy, cx = np.arange(gh) + 0.5, np.arange(gw) + 0.5
    for s in range(steps):
        scale = 1 - (1 - min_scale) * s / (steps - 1)
        w, h = fit(base_w * scale, sw), fit(base_h * scale, sh)
        cw, ch = w * gw / sw, h * gh / sh
        right, low = max(0, math.floor(gw - cw + 1e-9)), max(0, math.floor(gh - ch + 1e-9))
        at = lambda k, last, free: free if k == last else k
        places = [((gw - cw) / 2, (gh - ch) / 2)] + [(at(i, right, gw - cw), at(j, low, gh - ch)) for j in range(low + 1) for i in range(right + 1)]
        for n, (left, top) in enumerate(places):
            u, v = (cx - left) / cw, (cy - top) / ch
            ux, vy = np.flatnonzero((u >= 0) & (u < 1)), np.flatnonzero((v >= 0) & (v < 1))
            inside = cells[np.ix_(vy, ux)]
            score = float((inside * _placement(u[ux][None], v[vy][:, None], thirds)).sum() - outside * (total - inside.sum())) / (cw * ch)
            distance = (left + cw / 2 - gw / 2) ** 2 + (top + ch / 2 - gh / 2) ** 2
            slack = 1e-9 * max(1e-12, abs(score_of_best)) if math.isfinite(score_of_best) else 0.0
            if score > score_of_best + slack or (abs(score - score_of_best) <= slack and distance < distance_of_best - 1e-12):
                score_of_best, distance_of_best = max(score, score_of_best), distance
                x, y = ((sw - w) // 2, (sh - h) // 2) if n == 0 else (min(max(round(left * sw / gw), 0), sw - w), min(max(round(top * sh / gh), 0), sh - h))
                best = (x, y, w, h)
    return best


def smart_window(px: DataFrame, width: int, height: int, min_scale: float = 1.0, weights: tuple[float, float, float] = WEIGHTS, outside: float = OUTSIDE, thirds: bool = True, boosts: tuple = (), analysis: int = ANALYSIS) -> DataFrame:
    """image_id, x, y, width, height: the window of shape width to height that shows most of what matters in each image (r, g, b, a).

    Images of more than analysis pixels a side are reduced first; a grid of at most GRID x GRID sums
    is what is left of each, made band by band, and these alone meet where windows are scored.
    boosts are regions of the source ((x, y, width, height), weight) that matter more or less.
    """
    known = sized(px.select("image_id", "y", "x", *"rgba"))
    large = F.greatest("width", "height") > analysis
    reduce = F.lit(float(analysis)) / F.greatest("width", "height")
    side = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * reduce).cast("int"))
    small = known.where(~large).select("image_id", "y", "x", *"rgba").unionByName(resize(known.where(large).drop("width", "height"), side("width"), side("height"), "box", tuple("rgba"), "a"))
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).alias("sw"), (F.max("y") + 1).alias("sh"))
    placed = with_own(sized(small), sizes)
    extra = F.lit(0.0)
    for (left, top, w, h), more in boosts:
        fx, fy = F.col("sw") / F.col("width"), F.col("sh") / F.col("height")
        inside = (F.col("x") >= F.floor(left / fx)) & (F.col("x") < F.ceil((left + w) / fx)) & (F.col("y") >= F.floor(top / fy)) & (F.col("y") < F.ceil((top + h) / fy))
        extra = extra + F.when(inside, float(more)).otherwise(0.0)

    def summed(planes: dict[str, np.ndarray], top: int, first: int, high: int) -> dict[str, object]:
        wide = planes["r"].shape[1]
        size = max(1.0, max(wide, high) / GRID)
        matters = importance(planes, weights) + planes["extra"]
        own = range(first - top, min(first - top + 64, len(matters)))
        y = np.minimum(max(1, math.ceil(high / size)) - 1, ((np.arange(first, first + len(own)) + 0.5) / size).astype(np.int64))
        x = np.minimum(max(1, math.ceil(wide / size)) - 1, ((np.arange(wide) + 0.5) / size).astype(np.int64))
        cells = np.zeros((y.max() + 1, x.max() + 1))
        np.add.at(cells, (y[:, None], x[None]), matters[own.start : own.stop])
        v, u = np.mgrid[y.min() : y.max() + 1, 0 : x.max() + 1]
        return {"v": v.ravel().astype(np.int32), "u": u.ravel().astype(np.int32), "n": cells[y.min() :].ravel()}

    cells = over_bands(placed.withColumn("extra", extra), ["r", "g", "b", "a", "extra"], 1, 1, summed, "v int, u int, n double").groupBy("image_id", "v", "u").agg(F.sum("n").alias("n"))

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(rows["v"].max()) + 1, int(rows["u"].max()) + 1))
        grid[rows["v"], rows["u"]] = rows["n"]
        best = best_window(grid, (int(rows["sw"].iloc[0]), int(rows["sh"].iloc[0])), (width, height), min_scale, outside, thirds)
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]]} | {c: [np.int32(v)] for c, v in zip(("x", "y", "width", "height"), best, strict=True)})

    kind = px.schema["image_id"].dataType.simpleString()
    return cells.join(sizes, "image_id").groupBy("image_id").applyInPandas(found, f"image_id {kind}, x int, y int, width int, height int")


def smart_crop(px: DataFrame, width: int, height: int, sampler: str = "bicubic", **options) -> DataFrame:
    """image_id, y, x, r, g, b, a: the window that matters most of each image, resized to width x height."""
    window = smart_window(px, width, height, **options).withColumnsRenamed({"x": "_x", "y": "_y"})
    inside = with_own(px.select("image_id", "y", "x", *"rgba"), window).where("x >= _x and y >= _y and x < _x + width and y < _y + height")
    return resize(inside.select("image_id", (F.col("y") - F.col("_y")).alias("y"), (F.col("x") - F.col("_x")).alias("x"), *"rgba"), width, height, sampler, tuple("rgba"), "a")
