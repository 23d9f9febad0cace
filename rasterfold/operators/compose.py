"""Drawing one image over another: an equi-join on shifted places, then one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterfold.functions import color


def draw(px: DataFrame, over: DataFrame, at: tuple[int, int] = (0, 0), opacity: float = 1, blend: str = "normal", composition: str = "src_over", everywhere: bool = False) -> DataFrame:
    """image_id, y, x, r, g, b, a of px with over drawn at (x, y), images paired by image_id.

    over is drawn with its alpha times opacity, mixed by a blend mode and put together by a
    composition mode. everywhere draws the one image of over (its image_id plays no part) over all.
    """
    shifted = over.select(F.col("image_id").alias("_i"), (F.col("y") + at[1]).alias("_y"), (F.col("x") + at[0]).alias("_x"), *((F.col(c) / 255).alias(f"s{c}") for c in "rgb"), (F.col("a") / 255 * F.lit(float(opacity))).alias("sa"))
    same = [F.col("y") == F.col("_y"), F.col("x") == F.col("_x")] + ([] if everywhere else [F.col("image_id") == F.col("_i")])
    joined = px.join(shifted, same, "left")
    both = joined.select("image_id", "y", "x", *((F.col(c) / 255).alias(f"b{c}") for c in "rgba"), *(F.coalesce(f"s{c}", F.lit(0.0)).alias(f"s{c}") for c in "rgba"))
    return both.selectExpr("image_id", "y", "x", *(f"{e} AS {c}" for c, e in color.composed(blend, composition).items()))
