"""Projections: every pixel by itself, or with the size of its image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project(px: DataFrame, channels: dict[str, str]) -> DataFrame:
    """Replaces or adds columns, all computed from the columns as they were."""
    return px.withColumns({c: F.expr(e) for c, e in channels.items()})


def within(px: DataFrame, region: tuple[int, int, int, int], channels: dict[str, str]) -> DataFrame:
    """project limited to a rectangle (x, y, width, height)."""
    x, y, w, h = region
    inside = f"x BETWEEN {x} AND {x + w - 1} AND y BETWEEN {y} AND {y + h - 1}"
    return project(px, {c: f"CASE WHEN {inside} THEN {e} ELSE {c} END" for c, e in channels.items()})


#: The lines of an image are dealt over so many keys where they meet facts of the image.
LINES = 64


def with_own(px: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """px joined to the facts of its image (one row an image), which has LINES copies for as many groups of lines.

    So a large page is not one task's work where the facts are too many to be broadcast.
    """
    group = F.pmod(F.col("y"), F.lit(LINES))
    copies = facts.withColumn("_lines", F.explode(F.sequence(F.lit(0), F.lit(LINES - 1))))
    return px.withColumn("_lines", group.cast("int")).join(copies, ["image_id", "_lines"], how).drop("_lines")


def sized(px: DataFrame) -> DataFrame:
    """Adds width and height of each image, joined from one row an image (a partial aggregate, no window)."""
    return with_own(px, px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")))
