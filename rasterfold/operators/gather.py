"""Gathers: each target pixel asks for source pixels by computed coordinates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterfold.functions.color import inverted
from rasterfold.functions.numbers import byte, num


def taps(px: DataFrame, offsets: list[tuple], names: str, own: list[str]) -> DataFrame:
    """px joined to its neighbours at offsets (dy, dx, ...) inside the image; own columns are kept, the neighbour's level is q.

    The table of offsets is a literal exploded within the plan; the join is an equi-join on place.
    """
    rows = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names.split(), o, strict=True))) for o in offsets))).alias("_t")
    asked = px.select("image_id", "y", "x", *own, rows).select("image_id", "y", "x", *own, "_t.*").withColumns({"_y": F.col("y") + F.col("dy"), "_x": F.col("x") + F.col("dx")})
    given = px.select("image_id", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("l").alias("q"))
    return asked.join(given, ["image_id", "_y", "_x"])


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


def bilateral_taps(radius: int, spatial: float) -> list[tuple[int, int, float]]:
    return [(dy, dx, math.exp(-(dy * dy + dx * dx) / (2 * spatial * spatial))) for dy, dx in disk(radius)]


def source_place(matrix: tuple) -> tuple[str, str]:
    """Expressions for where a pixel (x, y) comes from under a projective map."""
    m = inverted(matrix)
    line = lambda r: f"({num(m[r][0])} * x + {num(m[r][1])} * y + {num(m[r][2])})"
    return f"round({line(0)} / {line(2)}, 9)", f"round({line(1)} / {line(2)}, 9)"


def warp(px: DataFrame, matrix: tuple) -> DataFrame:
    """l of each pixel from the four around its source, by distance; outside is 0. The canvas stays."""
    sx, sy = source_place(matrix)
    wanted = px.selectExpr("image_id", "y", "x", f"{sx} AS sx", f"{sy} AS sy").selectExpr("*", "CAST(floor(sx) AS INT) AS fx", "CAST(floor(sy) AS INT) AS fy")
    corners = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (0, 1) for i in (0, 1)))).alias("c")
    asked = wanted.select("*", corners).selectExpr("image_id", "y", "x", "fy + c.j AS _y", "fx + c.i AS _x", "(CASE WHEN c.i = 1 THEN sx - fx ELSE 1 - (sx - fx) END) * (CASE WHEN c.j = 1 THEN sy - fy ELSE 1 - (sy - fy) END) AS w")
    given = px.select("image_id", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("l").alias("q"))
    return asked.join(given, ["image_id", "_y", "_x"], "left").groupBy("image_id", "y", "x").agg(F.expr(byte("round(sum(w * coalesce(q, 0)), 5)")).alias("l"))


def rotation(degrees: float, cx: float, cy: float) -> tuple:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return ((c, -s, cx - c * cx + s * cy), (s, c, cy - s * cx - c * cy), (0, 0, 1))
