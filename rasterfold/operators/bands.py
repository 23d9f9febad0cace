"""Neighbourhoods by bands: a task gets some lines of an image and those around them, as whole arrays.

Pixels are gathered to lines in the JVM, so that Python gets one row a line; no task holds more than
a band of an image and its margin, whatever the image's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.operators.lines import to_lines

BAND = 64


def over_bands(px: DataFrame, columns: list[str], above: int | Column, below: int | Column, work: Callable[[dict[str, np.ndarray], int, int, int], dict[str, object]], returns: str, band: int = BAND, placed: bool = False) -> DataFrame:
    """image_id and what work makes of each band of lines, with above and below lines around it where the image has them.

    above and below may be expressions over height, the number of lines of each image. work gets an
    array (lines, places) of each column, the number of its first line, the first line of the band,
    whose lines are those from there up to band lines on, and the image's height; it returns
    columns. Lines that are shorter than others of a band are filled up with their last value. With
    placed, work also gets the y of the lines (_v) and the x of their places (_u).
    """
    lines = to_lines(px, *columns, places="_u" if placed else None)
    lines = lines.join(lines.groupBy("image_id").agg((F.max("y") + 1).alias("height")), "image_id")
    place = lambda e: F.floor(e / band).cast("int")
    last = F.least(place(F.col("height") - 1), place(F.col("y") + above))
    dealt = lines.withColumn("_band", F.explode(F.sequence(F.greatest(F.lit(0), place(F.col("y") - below)), last)))

    def worked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("y", ignore_index=True)
        first = int(key[1]) * band
        width = rows[columns[0]].map(len).max()
        planes = {c: np.stack([np.pad(np.asarray(v, np.float64), (0, width - len(v)), "edge") for v in rows[c]]) for c in columns}
        if placed:
            own = [np.arange(len(v)) if u is None else np.asarray(u) for u, v in zip(rows["_u"], rows[columns[0]], strict=True)]
            planes |= {"_v": rows["y"].to_numpy(), "_u": np.stack([np.pad(u, (0, width - len(u)), "edge") for u in own])}
        return pd.DataFrame({"image_id": key[0], **work(planes, int(rows["y"].iloc[0]), first, int(rows["height"].iloc[0]))})

    kind = px.schema["image_id"].dataType.simpleString()
    return dealt.groupBy("image_id", "_band").applyInPandas(worked, f"image_id {kind}, {returns}")


def halved(px: DataFrame, *columns: str) -> DataFrame:
    """The next image of a pyramid: means of two by two pixels, of those that are there at odd ends."""
    return px.groupBy("image_id", F.expr("y div 2").cast("int").alias("y"), F.expr("x div 2").cast("int").alias("x")).agg(*(F.avg(c).alias(c) for c in columns))


def spread_out(lines: DataFrame, *columns: str) -> DataFrame:
    """image_id, y, x and columns of lines that have an array of each."""
    return lines.select("image_id", "y", F.posexplode(F.arrays_zip(*columns)).alias("x", "p")).select("image_id", "y", "x", *(f"p.{c}" for c in columns))
