"""Where pixels go: crops, canvases, turns, and resizing by weights. All take any channels and any sizes.

Sizes are those of each image (its largest x and y and one), unless they are given.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.functions.kernels import SAMPLERS, axis_taps
from rasterfold.operators.pixels import sized, with_own

#: Target lines that are made in one group; a group gets the source lines that these need.
BAND = 64
ANCHORS = {f"{v}_{h}".strip("_"): (j, i) for j, v in ((0, "top"), (1, ""), (2, "bottom")) for i, h in ((0, "left"), (1, ""), (2, "right"))} | {"center": (1, 1)}


def _moved(px: DataFrame, y: Column, x: Column) -> DataFrame:
    rest = [c for c in px.columns if c not in ("y", "x", "width", "height")]
    return px.withColumns({"_y": y.cast("int"), "_x": x.cast("int")}).select("image_id", F.col("_y").alias("y"), F.col("_x").alias("x"), *(c for c in rest if c != "image_id"))


def _of_size(px: DataFrame, size: tuple[int, int] | None) -> DataFrame:
    """px with width and height: the given ones, or each image's own."""
    return sized(px) if size is None else px.withColumns({"width": F.lit(size[0]), "height": F.lit(size[1])})


def crop(px: DataFrame, region: tuple[int, int, int, int]) -> DataFrame:
    """The rectangle (x, y, width, height) of each image; what is outside an image stays away."""
    left, top, w, h = region
    return _moved(px.where(F.col("x").between(left, left + w - 1) & F.col("y").between(top, top + h - 1)), F.col("y") - top, F.col("x") - left)


def flip(px: DataFrame, axis: str, size: tuple[int, int] | None = None) -> DataFrame:
    """Mirrored left to right (horizontal) or top to bottom (vertical)."""
    px = _of_size(px, size)
    return _moved(px, F.col("y"), F.col("width") - 1 - F.col("x")) if axis == "horizontal" else _moved(px, F.col("height") - 1 - F.col("y"), F.col("x"))


def turn(px: DataFrame, degrees: int, size: tuple[int, int] | None = None) -> DataFrame:
    """Turned clockwise by a multiple of 90 degrees."""
    px, x, y = _of_size(px, size), F.col("x"), F.col("y")
    at = {0: (y, x), 90: (x, F.col("height") - 1 - y), 180: (F.col("height") - 1 - y, F.col("width") - 1 - x), 270: (F.col("width") - 1 - x, y)}
    return _moved(px, *at[degrees % 360])


def transpose(px: DataFrame) -> DataFrame:
    return _moved(px, F.col("x"), F.col("y"))


def orient(px: DataFrame, orientation: str | Column = "orientation", size: tuple[int, int] | None = None) -> DataFrame:
    """Upright images by their orientation tag of 1 to 8 (others: as they are)."""
    px = _of_size(px.withColumn("_o", F.col(orientation) if isinstance(orientation, str) else orientation), size)
    x, y, right, low = F.col("x"), F.col("y"), F.col("width") - 1 - F.col("x"), F.col("height") - 1 - F.col("y")
    # Where the row and the column of each orientation go.
    to_y = F.when(F.col("_o").isin(3, 4), low).when(F.col("_o").isin(5, 6), x).when(F.col("_o").isin(7, 8), right).otherwise(y)
    to_x = F.when(F.col("_o").isin(2, 3), right).when(F.col("_o").isin(5, 8), y).when(F.col("_o").isin(6, 7), low).otherwise(x)
    return _moved(px, to_y, to_x).drop("_o")


def blank(px: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, y, x of an empty canvas for each image."""
    rows = px.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return rows.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))


def place(px: DataFrame, width: int, height: int, at: tuple[int, int], fill: dict[str, int]) -> DataFrame:
    """Each image at (x, y) of a canvas; what it doesn't cover has the colour fill (channel: value)."""
    moved = _moved(px, F.col("y") + at[1], F.col("x") + at[0])
    return blank(px, width, height).join(moved, ["image_id", "y", "x"], "left").fillna(fill)


def fitted(mode: str, width: int, height: int, w: str = "width", h: str = "height", anchor: str = "center") -> dict[str, Column]:
    """Columns out_w, out_h (canvas), draw_w, draw_h (the resized image) and draw_x, draw_y (its place), from columns w and h.

    stretch fills the size; max is the largest that fits in it, min the smallest that covers it
    (no larger than the source); crop covers it and cuts, pad fits and fills up, box_pad does so
    only for images that are larger. anchor says where a cut or padded image stays.
    """
    w, h, tw, th = F.col(w), F.col(h), F.lit(width), F.lit(height)
    rounded = lambda e: F.greatest(F.lit(1), F.floor(e + 0.5)).cast("int")
    fit, cover = F.least(width / w, height / h), F.greatest(width / w, height / h)
    if mode == "stretch":
        out, draw = (tw, th), (tw, th)
    elif mode in ("max", "min"):
        ratio = fit if mode == "max" else F.least(F.lit(1.0), cover)
        out = draw = (rounded(w * ratio), rounded(h * ratio))
    elif mode == "crop":
        out, draw = (tw, th), (rounded(w * cover), rounded(h * cover))
    elif mode in ("pad", "box_pad"):
        small = (w <= width) & (h <= height) if mode == "box_pad" else F.lit(False)
        out, draw = (tw, th), (F.when(small, w).otherwise(rounded(w * fit)), F.when(small, h).otherwise(rounded(h * fit)))
    else:
        raise ValueError(f"no such mode: {mode}")
    j, i = ANCHORS[anchor]
    at = [F.floor((o - d) * k / 2).cast("int") for o, d, k in ((out[0], draw[0], i), (out[1], draw[1], j))]
    return dict(zip(("out_w", "out_h", "draw_w", "draw_h", "draw_x", "draw_y"), (*(c.cast("int") for c in (*out, *draw)), *at), strict=True))


def resize_nearest(px: DataFrame, width: int, height: int) -> DataFrame:
    """Each image at width x height, target (x, y) taking the source pixel (x * source width // width, ...), whatever channels there are.

    Every source pixel knows which target lines and columns ask for it, so nothing is joined but sizes.
    """
    source = sized(px)
    asking = lambda at, side, n: F.sequence(F.ceil(F.col(at) * n / F.col(side)), F.ceil((F.col(at) + 1) * n / F.col(side)) - 1)
    any_asks = lambda at, side, n: F.ceil((F.col(at) + 1) * n / F.col(side)) > F.ceil(F.col(at) * n / F.col(side))
    wanted = source.where(any_asks("y", "height", height) & any_asks("x", "width", width)).withColumn("_y", F.explode(asking("y", "height", height))).withColumn("_x", F.explode(asking("x", "width", width)))
    rest = [c for c in px.columns if c not in ("image_id", "y", "x")]
    return wanted.select("image_id", F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x"), *rest)


def _weights(source: int, target: int, sampler: str) -> np.ndarray:
    out = np.zeros((target, source))
    for t, s, w in axis_taps(source, target, sampler):
        out[t, s] = w
    return out


def resize(px: DataFrame, width: int | Column, height: int | Column, sampler: str = "bicubic", channels: tuple[str, ...] = ("l",), alpha: str | None = None, linear: bool = False) -> DataFrame:
    """image_id, y, x and bytes of each channel, resampled to width x height from images of any size.

    width and height may be expressions over the columns width and height that each image has, so
    that every image gets a size of its own. With alpha (one of the channels) the others are weighed by it, so that transparent colours
    don't bleed; linear resamples light instead of sRGB values (not alpha). Pixels are dealt to
    bands of target lines, each with the source lines that its taps reach, so no task holds more
    than a band of an image; within a band two matrix products do the work.
    """
    radius, _ = SAMPLERS[sampler]
    wanted = [(F.lit(n) if isinstance(n, int) else n).cast("int").alias(name) for n, name in ((width, "_w"), (height, "_h"))]
    source = sized(px.select("image_id", "y", "x", *channels)).select("*", *wanted)
    scale = F.greatest(F.lit(1.0), F.col("height") / F.col("_h"))
    margin = scale * radius + 1
    band = lambda e: F.greatest(F.lit(0), F.least(F.floor((F.col("_h") - 1) / BAND).cast("int"), F.floor(((e + 0.5) * F.col("_h") / F.col("height") - 0.5) / BAND).cast("int")))
    dealt = source.withColumn("_band", F.explode(F.sequence(band(F.col("y") - margin), band(F.col("y") + margin))))

    def resampled(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w, h, width, height = (int(rows[c].iloc[0]) for c in ("width", "height", "_w", "_h"))
        top, first = int(rows["y"].min()), int(key[1]) * BAND
        lines = np.zeros((len(channels), int(rows["y"].max()) - top + 1, w))
        lines[:, rows["y"].to_numpy() - top, rows["x"].to_numpy()] = rows[list(channels)].to_numpy(np.float64).T
        colours = [i for i, c in enumerate(channels) if c != alpha]
        if linear:
            v = lines[colours] / 255
            lines[colours] = 255 * np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
        if alpha:
            lines[colours] *= lines[channels.index(alpha)] / 255
        down = _weights(h, height, sampler)[first : first + BAND]
        inside = np.zeros((len(down), lines.shape[1]))
        last = min(h, top + lines.shape[1])
        inside[:, : last - top] = down[:, top:last]
        out = inside @ (lines @ _weights(w, width, sampler).T)
        if alpha:
            a = np.maximum(out[channels.index(alpha)], 1e-9)
            out[colours] = np.where(a > 1e-6, out[colours] * 255 / a, 0)
        if linear:
            v = np.clip(out[colours] / 255, 0, 1)
            out[colours] = 255 * np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055)
        out = np.clip(np.floor(np.round(out, 6) + 0.5), 0, 255).astype(np.int32)
        y, x = np.indices(out.shape[1:])
        return pd.DataFrame({"image_id": key[0], "y": (y + first).ravel().astype(np.int32), "x": x.ravel().astype(np.int32)} | {c: out[i].ravel() for i, c in enumerate(channels)})

    kind = px.schema["image_id"].dataType.simpleString()
    return dealt.groupBy("image_id", "_band").applyInPandas(resampled, f"image_id {kind}, y int, x int, " + ", ".join(f"{c} int" for c in channels))


def resize_by_mode(px: DataFrame, mode: str, width: int, height: int, sampler: str = "bicubic", channels: tuple[str, ...] = ("l",), fill: dict[str, int] | None = None, anchor: str = "center", alpha: str | None = None, linear: bool = False) -> DataFrame:
    """Each image resized as mode says (see fitted), from its own size: stretched, fitted, covering and cut, or on a canvas.

    Where the canvas is larger than the resized image, it has the colour fill (channel: value; 0).
    """
    plan = fitted(mode, width, height, anchor=anchor)
    small = resize(px, plan["draw_w"], plan["draw_h"], sampler, channels, alpha, linear)
    if mode in ("stretch", "max", "min"):
        return small
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    places = sizes.select("image_id", *(plan[c].alias(c) for c in ("out_w", "out_h", "draw_x", "draw_y")))
    moved = with_own(small, places).withColumns({"y": F.col("y") + F.col("draw_y"), "x": F.col("x") + F.col("draw_x")})
    moved = moved.where("y >= 0 and x >= 0 and y < out_h and x < out_w").select("image_id", "y", "x", *channels)
    if mode == "crop":
        return moved
    fill = dict.fromkeys(channels, 0) | (fill or {})
    return blank(px, width, height).join(moved, ["image_id", "y", "x"], "left").fillna(fill)
