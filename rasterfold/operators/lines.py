"""Neighbourhoods over lines: an image is a few rows, each with the array of its pixels.

Gathering pixels to lines costs one shuffle; then lag and lead over the lines of an image reach up
and down, and array functions reach left and right, however many taps a kernel has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _line():
    return W.partitionBy("image_id").orderBy("y")


def _whole():
    return _line().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def to_lines(px: DataFrame, *columns: str, places: str | None = None) -> DataFrame:
    """image_id, y, and an array by x of each column; places names one more of the x, null where they are 0 and on without a gap."""
    lines = px.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", *columns))).alias("_p"))
    whole = "element_at(_p, 1).x = 0 AND element_at(_p, -1).x = size(_p) - 1"
    own = [F.expr(f"CASE WHEN {whole} THEN NULL ELSE transform(_p, p -> p.x) END").alias(places)] if places else []
    return lines.select("image_id", "y", *(F.expr(f"transform(_p, p -> p.{c})").alias(c) for c in columns), *own)


def to_pixels(lines: DataFrame, *columns: str) -> DataFrame:
    zipped = F.arrays_zip(*columns)
    return lines.select("image_id", "y", F.posexplode(zipped).alias("x", "_p")).select("image_id", "y", "x", *(f"_p.{c}" for c in columns))


def above_or_below(column: str, dy: int) -> Column:
    """The line dy further down, the outermost line beyond the edge."""
    if dy == 0:
        return F.col(column)
    if dy < 0:
        return F.coalesce(F.lag(column, -dy).over(_line()), F.first(column).over(_whole()))
    return F.coalesce(F.lead(column, dy).over(_line()), F.last(column).over(_whole()))


def with_neighbours(lines: DataFrame, column: str, dys: list[int]) -> DataFrame:
    return lines.select("*", *(above_or_below(column, dy).alias(f"_{column}_{dy + 100}") for dy in dys))


def weighted(column: str, taps: list[tuple[int, int, float]]) -> str:
    """The sum over taps (dy, dx, weight) at place i of with_neighbours' lines, edges repeated."""
    place = lambda dx: f"element_at({{}}, greatest(1, least(size({column}), i + 1 + ({dx}))))"
    return " + ".join(f"{w!r}D * {place(dx).format(f'_{column}_{dy + 100}')}" for dy, dx, w in taps)


def convolve(px: DataFrame, column: str, kernels: dict[str, list[tuple[int, int, float]]]) -> DataFrame:
    """image_id, y, x and for each kernel its sum of column, correlated at the anchor, edges repeated."""
    dys = sorted({dy for taps in kernels.values() for dy, _, _ in taps})
    lines = with_neighbours(to_lines(px, column), column, dys)
    sums = (F.expr(f"transform({column}, (v, i) -> {weighted(column, taps)})").alias(name) for name, taps in kernels.items())
    return to_pixels(lines.select("image_id", "y", *sums), *kernels)


def convolve_channels(px: DataFrame, channels: tuple[str, ...], kernels: dict[str, list[tuple[int, int, float]]], keep: bool = False) -> DataFrame:
    """image_id, y, x and for each channel and kernel its sum (channel_kernel), as convolve has it; keep leaves the channels.

    All channels of a line travel together, so more of them ask for no more shuffles.
    """
    dys = sorted({dy for taps in kernels.values() for dy, _, _ in taps})
    lines = to_lines(px, *channels)
    for c in channels:
        lines = with_neighbours(lines, c, dys)
    named = {f"{c}_{name}": f"transform({c}, (v, i) -> {weighted(c, taps)})" for c in channels for name, taps in kernels.items()}
    kept = list(channels) if keep else []
    return to_pixels(lines.select("image_id", "y", *kept, *(F.expr(e).alias(name) for name, e in named.items())), *kept, *named)


def rank_channels(px: DataFrame, channels: tuple[str, ...], offsets: list[tuple[int, int]], rank: str) -> DataFrame:
    """image_id, y, x and the min, max or median of each channel over offsets (dy, dx) of any shape, edges repeated."""
    lines = to_lines(px, *channels)
    for c in channels:
        lines = with_neighbours(lines, c, sorted({dy for dy, _ in offsets}))
    middle = len(offsets) // 2 + 1
    shape = {"min": "array_min({0})", "max": "array_max({0})", "median": f"element_at(array_sort({{0}}), {middle})"}[rank]
    around = lambda c: "array(" + ", ".join(f"element_at(_{c}_{dy + 100}, greatest(1, least(size({c}), i + 1 + ({dx}))))" for dy, dx in offsets) + ")"
    found = (F.expr(f"transform({c}, (v, i) -> {shape.format(around(c))})").alias(c) for c in channels)
    return to_pixels(lines.select("image_id", "y", *found), *channels)


def separable(px: DataFrame, column: str, weights: tuple, name: str = "blur", keep: bool = False) -> DataFrame:
    """The same weights down and then across, edges repeated; keep leaves the column itself beside the result."""
    radius = len(weights) // 2
    lines = with_neighbours(to_lines(px, column), column, list(range(-radius, radius + 1)))
    down = " + ".join(f"{w!r}D * element_at(_{column}_{k - radius + 100}, i + 1)" for k, w in enumerate(weights))
    lines = lines.withColumn("_down", F.expr(f"transform({column}, (v, i) -> {down})"))
    across = " + ".join(f"{w!r}D * element_at(_down, greatest(1, least(size(_down), i + 1 + ({k - radius}))))" for k, w in enumerate(weights))
    kept = [column] if keep else []
    return to_pixels(lines.select("image_id", "y", *kept, F.expr(f"transform(_down, (v, i) -> {across})").alias(name)), *kept, name)


def rank_filter(px: DataFrame, column: str, radius: int, rank: str, name: str = "v") -> DataFrame:
    """min, max or median of the square of 2 radius + 1, edges repeated."""
    lines = with_neighbours(to_lines(px, column), column, list(range(-radius, radius + 1)))
    square = ", ".join(f"element_at(_{column}_{dy + 100}, greatest(1, least(size({column}), i + 1 + ({dx}))))" for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1))
    middle = (2 * radius + 1) ** 2 // 2 + 1
    value = {"min": f"array_min(array({square}))", "max": f"array_max(array({square}))", "median": f"element_at(array_sort(array({square})), {middle})"}[rank]
    return to_pixels(lines.select("image_id", "y", F.expr(f"transform({column}, (v, i) -> {value})").alias(name)), name)
