"""Images as arrays of numbers, for models: one row an image, and back to pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.functions.numbers import byte, num
from rasterfold.operators import geometry


def _channel(k: int) -> Callable[[Column], Column]:
    return lambda p: F.element_at(p["v"], k + 1)


def to_tensor(px: DataFrame, layout: str = "chw", channels: tuple[str, ...] = ("r", "g", "b"), mean: tuple[float, ...] = (), std: tuple[float, ...] = ()) -> DataFrame:
    """image_id, height, width, tensor: (channel / 255 - mean) / std, channel after channel (chw) or pixel after pixel (hwc).

    channels may be in any order (b, g, r), or one alone (l).
    """
    mean, std = mean or (0,) * len(channels), std or (1,) * len(channels)
    values = [F.expr(f"({c} / 255e0 - {num(m)}) / {num(s)}") for c, m, s in zip(channels, mean, std, strict=True)]
    gathered = px.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.array_sort(F.collect_list(F.struct("y", "x", F.array(*values).alias("v")))).alias("_p"))
    if layout == "hwc":
        tensor = F.flatten(F.transform("_p", lambda p: p["v"]))
    else:
        tensor = F.concat(*(F.transform("_p", _channel(k)) for k in range(len(channels))))
    return gathered.select("image_id", "height", "width", tensor.alias("tensor"))


def from_tensor(tensors: DataFrame, layout: str = "chw", channels: tuple[str, ...] = ("r", "g", "b"), mean: tuple[float, ...] = (), std: tuple[float, ...] = ()) -> DataFrame:
    """image_id, y, x and the channels as bytes, from rows as to_tensor makes them."""
    n, mean, std = len(channels), mean or (0,) * len(channels), std or (1,) * len(channels)
    pixels = F.col("height") * F.col("width")
    at = (lambda k: F.col("_i") * n + k + 1) if layout == "hwc" else (lambda k: pixels * k + F.col("_i") + 1)
    rows = tensors.select("*", F.explode(F.sequence(F.lit(0), (pixels - 1).cast("int"))).alias("_i"))
    taken = rows.select("image_id", F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"), (F.col("_i") % F.col("width")).cast("int").alias("x"), *(F.element_at("tensor", at(k).cast("int")).alias(c) for k, c in enumerate(channels)))
    return taken.selectExpr("image_id", "y", "x", *(f"{byte(f'round(({c} * {num(s)} + {num(m)}) * 255e0, 6)')} AS {c}" for c, m, s in zip(channels, mean, std, strict=True)))


def resize_to_tensor(px: DataFrame, width: int, height: int, sampler: str = "bicubic", channels: tuple[str, ...] = ("r", "g", "b"), **options) -> DataFrame:
    """to_tensor of the images resized to width x height."""
    return to_tensor(geometry.resize(px, width, height, sampler, channels), channels=channels, **options)
