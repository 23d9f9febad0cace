"""Thresholds of gray images, global by histogram and local by box sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterfold.operators.pixels import with_own


def histogram(px: DataFrame, level: str = "l") -> DataFrame:
    return px.groupBy("image_id", F.col(level).alias("level")).agg(F.count("*").alias("n"))


def otsu(px: DataFrame) -> DataFrame:
    """image_id, t: the level that parts each image with the largest variance between the two sides, 127 if none does.

    Only histograms are shuffled: 256 rows an image at most, whatever its size.
    """
    upto = W.partitionBy("image_id").orderBy("level")
    whole = W.partitionBy("image_id")
    h = histogram(px).select("image_id", "level", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("level")).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("level")).over(whole).alias("s"))
    between = F.expr("CAST(w0 AS DOUBLE) * (w - w0) * power(s0 / CAST(w0 AS DOUBLE) - (s - s0) / CAST(w - w0 AS DOUBLE), 2)")
    best = h.where("w0 < w").groupBy("image_id").agg(F.max(F.struct(between.alias("v"), (-F.col("level")).alias("minus"))).alias("m"))
    images = h.select("image_id").distinct()
    return images.join(best, "image_id", "left").select("image_id", F.coalesce(-F.col("m.minus"), F.lit(127)).cast("int").alias("t"))


def otsu_threshold(px: DataFrame) -> DataFrame:
    """Pixels above their image's threshold are white; the thresholds meet the pixels line by line."""
    return with_own(px, otsu(px)).select("image_id", "y", "x", F.when(F.col("l") > F.col("t"), 255).otherwise(0).alias("l"))


def integral(px: DataFrame, column: str = "l") -> DataFrame:
    """Sums over all pixels up and to the left, of values and of squares."""
    across = W.partitionBy("image_id", "y").orderBy("x")
    down = W.partitionBy("image_id", "x").orderBy("y")
    rows = px.withColumn("_s", F.sum(column).over(across)).withColumn("_q", F.sum(F.col(column) * F.col(column)).over(across))
    return rows.select("image_id", "y", "x", F.sum("_s").over(down).alias("sum"), F.sum("_q").over(down).alias("sum2"))


def box_statistics(px: DataFrame, radius: int) -> DataFrame:
    """px with n, mean and std over the square of 2 radius + 1, clipped at the borders."""
    across = W.partitionBy("image_id", "y").orderBy("x").rangeBetween(-radius, radius)
    down = W.partitionBy("image_id", "x").orderBy("y").rangeBetween(-radius, radius)
    rows = px.select("*", F.sum("l").over(across).alias("_s"), F.sum(F.col("l") * F.col("l")).over(across).alias("_q"), F.count("*").over(across).alias("_n"))
    sums = rows.select("image_id", "y", "x", "l", F.sum("_s").over(down).alias("s"), F.sum("_q").over(down).alias("q"), F.sum("_n").over(down).alias("n"))
    return sums.select("image_id", "y", "x", "l", "n", F.expr(MEAN).alias("m"), F.expr(STD).alias("d"))


MEAN = "CAST(s AS DOUBLE) / n"
STD = "sqrt(greatest(0e0, CAST(q AS DOUBLE) / n - (CAST(s AS DOUBLE) / n) * (CAST(s AS DOUBLE) / n)))"
#: Whether a pixel is paper: level l, local mean m and deviation d of n pixels, image minimum lo, largest deviation dmax.
LOCAL = {
    "bradley": "CAST(l AS DOUBLE) * n >= m * n * 0.85e0",
    "sauvola": "l > m * (1 + 0.2e0 * (d / 128 - 1))",
    "niblack": "l >= m - 0.2e0 * d",
    "wolf_jolion": "l > 0.5e0 * m + 0.5e0 * lo + 0.5e0 * (CASE WHEN dmax > 0 THEN d / dmax ELSE 0e0 END) * (m - lo)",
    "phansalkar": "l / 255e0 > m / 255 * (1 + 2e0 * exp(-10e0 * m / 255) + 0.25e0 * (d / 127.5e0 - 1))",
    "nick": "l >= m - 0.1e0 * sqrt(greatest(0e0, d * d + m * m - m * m / n))",
}


def local_threshold(px: DataFrame, method: str, radius: int) -> DataFrame:
    stats = box_statistics(px, radius)
    if method == "wolf_jolion":
        bounds = stats.groupBy("image_id").agg(F.min("l").alias("lo"), F.max("d").alias("dmax"))
        stats = with_own(stats, bounds)
    return stats.select("image_id", "y", "x", F.when(F.expr(LOCAL[method]), 255).otherwise(0).alias("l"))
