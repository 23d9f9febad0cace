"""Bilateral filtering on a coarse grid of place and level, by tiles: no task holds more than a tile of an image and its margin."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kernel that is run along each axis, and a cell's side for a deviation of one (the kernel and both interpolations together have the variance of the filter).
KERNEL = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)
CELL = 1 / math.sqrt(4 / 3)
#: Lines and places of a tile at least, pixels and cells of a grid that are worked on at once, layers of a grid from which on empty ones are left out.
TILE, PIECE, CELLS, LAYERS = (64, 256), 1 << 17, 1 << 22, 512


def _blurred(cells: np.ndarray, axis: int) -> np.ndarray:
    cells = np.moveaxis(cells, axis, 0)
    out = cells * KERNEL[2]
    for k in (1, 2):
        out[k:] += cells[:-k] * KERNEL[2 - k]
        out[:-k] += cells[k:] * KERNEL[2 + k]
    return np.moveaxis(out, 0, axis)


def _layers(z: np.ndarray) -> np.ndarray:
    """z with runs of layers that no pixel is near to left out, where there are many layers."""
    if int(z.max()) < LAYERS:
        return z
    known, place = np.unique(z, return_inverse=True)
    return np.concatenate([[0], np.cumsum(np.minimum(np.diff(known), 6))])[place]


def _smoothed(level: np.ndarray, tile: np.ndarray, g: tuple[np.ndarray, np.ndarray, np.ndarray], shape: tuple[int, int, int]) -> np.ndarray:
    """Levels after the filter: dealt to the cells around their places g (z, v, u) in the grid of their tile, blurred, and read again."""
    low = [np.floor(p).astype(np.int64) for p in g]
    part = [p - q for p, q in zip(g, low, strict=True)]
    low[0] = _layers(low[0])
    n, v, u = shape
    z = int(low[0].max()) + 2
    at = ((tile * z + low[0]) * v + low[1]) * u + low[2]
    corners = [(dz, dy, dx) for dz in (0, 1) for dy in (0, 1) for dx in (0, 1)]
    where = np.stack([at + (dz * v + dy) * u + dx for dz, dy, dx in corners])
    share = [(1 - p, p) for p in part]
    weight = np.stack([share[0][dz] * share[1][dy] * share[2][dx] for dz, dy, dx in corners])
    sums = []
    for given in (weight * level, weight):
        cells = np.bincount(where.ravel(), given.ravel(), n * z * v * u).reshape(n, z, v, u)
        for axis in (3, 2, 1):
            cells = _blurred(cells, axis)
        sums.append((cells.ravel()[where] * weight).sum(0))
    return np.where(sums[1] > 1e-12, sums[0] / np.where(sums[1] > 1e-12, sums[1], 1), level)


def _tiled(y: np.ndarray, x: np.ndarray, tile: np.ndarray, channels: list[np.ndarray], least: list[np.ndarray], top: np.ndarray, left: np.ndarray, side: float, depth: float) -> list[np.ndarray]:
    """Channels of the pixels of some tiles (in order of them) after the filter; least are the least levels of each pixel's image, top and left the first cells of the tiles."""
    gy, gx = y / side - top[tile], x / side - left[tile]
    first = np.flatnonzero(np.diff(tile, prepend=-1))
    high, wide = (np.maximum.reduceat(np.floor(g).astype(np.int64), first) + 2 for g in (gy, gx))
    out = [np.zeros(len(y), np.int32) for _ in channels]
    shapes, kind = np.unique(np.stack([high, wide]), axis=1, return_inverse=True)
    order = np.cumsum(np.diff(tile, prepend=-1) != 0) - 1  # tiles that have pixels, from 0
    for k, (v, u) in enumerate(shapes.T.tolist()):
        mine = kind.ravel() == k
        place = np.cumsum(mine) - 1
        for c, level in enumerate(channels):
            given = mine[order] & np.isfinite(level)
            if not given.any():
                continue
            z = np.where(given, (level - least[c]) / depth, 0.0)
            each = max(1, CELLS // (v * u * (min(LAYERS, int(z.max())) + 2)))
            for start in range(0, int(place[-1]) + 1, each):
                some = np.flatnonzero(given & (place[order] >= start) & (place[order] < start + each))
                if len(some):
                    found = _smoothed(level[some], place[order[some]] - start, (z[some], gy[some], gx[some]), (each if start + each <= place[-1] else int(place[-1]) + 1 - start, v, u))
                    out[c][some] = np.clip(np.floor(np.round(found, 5) + 0.5), 0, 255).astype(np.int32)
    return out


def bilateral_grid(px: DataFrame, spatial: float, levels: float, channels: tuple[str, ...] = ("l",)) -> DataFrame:
    """image_id, y, x and channels, smoothed over places (deviation spatial) and levels (deviation levels).

    Each channel has a grid of its own, from its least level in the image up. Pixels are dealt once, to
    tiles and the margins that the filter reaches into; tiles are wider the wider the filter, so the
    cost doesn't grow with its radius. The least levels come to each tile as a pixel above it. A
    task has a tile at a time, or many small ones; pixels without a level come out as 0.
    """
    side, depth = spatial * CELL, levels * CELL
    margin = math.ceil(4 * side)
    tall, wide = (max(t, 4 * margin) for t in TILE)
    kinds = {c: px.schema[c].dataType.simpleString() for c in channels}
    missing = {c: F.lit(-(2**31)).cast("int") if k == "int" else F.lit(float("nan")) for c, k in kinds.items()}
    level = [F.coalesce(F.col(c) if kinds[c] == "int" else F.col(c).cast("double"), missing[c]).alias(c) for c in channels]

    def tiles(at: str, size: int) -> Column:
        reached = F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - margin) / size).cast("int")), F.floor((F.col(at) + margin) / size).cast("int"))
        return F.explode(reached)

    own = px.groupBy("image_id").agg(*(F.min(c).alias(c) for c in channels), F.max("y").alias("_y"), F.max("x").alias("_x"))
    upto = lambda at, size: F.explode(F.sequence(F.lit(0), F.floor(F.col(at) / size).cast("int")))
    facts = own.withColumn("_v", upto("_y", tall)).withColumn("_u", upto("_x", wide)).select("image_id", "_v", "_u", F.lit(-1).alias("y"), F.lit(-1).alias("x"), *level)
    pixels = px.withColumn("_v", tiles("y", tall)).withColumn("_u", tiles("x", wide)).select("image_id", "_v", "_u", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *level)
    gathered = pixels.unionByName(facts).groupBy("image_id", "_v", "_u").agg(*(F.collect_list(c).alias(c) for c in ("y", "x", *channels)))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = np.concatenate([[0], np.cumsum(batch.column("y").value_lengths().to_numpy().astype(np.int64))])
            at = 0
            while at < batch.num_rows:
                more = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PIECE, "right")) - 1)
                some = batch.slice(at, more - at)
                at = more
                tile = np.repeat(np.arange(some.num_rows), some.column("y").value_lengths().to_numpy())
                y, x, *values = (some.column(c).flatten().to_numpy() for c in ("y", "x", *channels))
                values = [np.where(v == -(2**31), np.nan, v) if kinds[c] == "int" else v for c, v in zip(channels, values, strict=True)]
                v, u = (some.column(c).to_numpy().astype(np.int64) for c in ("_v", "_u"))
                fact = y < 0
                least = [np.full(some.num_rows, np.nan) for _ in channels]
                for known, value in zip(least, values, strict=True):
                    known[tile[fact]] = value[fact]
                real = ~fact & np.isin(tile, tile[fact])  # a tile beyond the image has no fact
                if not real.any():
                    continue
                tile, y, x, values = tile[real], y[real], x[real], [p[real] for p in values]
                top, left = (np.floor(np.maximum(0, k * size - margin) / side) for k, size in ((v, tall), (u, wide)))
                out = _tiled(y, x, tile, values, [p[tile] for p in least], top, left, side, depth)
                inner = (y // tall == v[tile]) & (x // wide == u[tile])
                ids = some.column("image_id").take(pa.array(tile[inner]))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(p[inner], pa.int32()) for p in (y, x, *out))], ["image_id", "y", "x", *channels])

    kind = px.schema["image_id"].dataType.simpleString()
    return gathered.mapInArrow(filtered, f"image_id {kind}, y int, x int, " + ", ".join(f"{c} int" for c in channels))
