"""Lines and words of pages of ink, by runs of inked rows and gaps between inked columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterfold.operators.cut import written
from rasterfold.operators.upright import without_rules

#: Lowest line, least gap between words, its share of the line's height.
LOWEST, WORD_GAP, GAP_SHARE = 2, 2, 0.4


def text_lines(px: DataFrame) -> DataFrame:
    """image_id, line (from 1), top, bottom (last row): runs of inked rows, with dots and accents merged to the line beside them.

    A run lower than half the middle run, or one beside such a run, is merged to the run before it
    if they are at most a third of the middle height apart. Only runs of a page meet, of which there
    are half as many as it has rows.
    """
    down = W.partitionBy("image_id").orderBy("y")
    rows = px.where("ink = 1").select("image_id", "y").distinct().withColumn("g", F.col("y") - F.row_number().over(down))
    runs = rows.groupBy("image_id", "g").agg(F.min("y").alias("top"), F.max("y").alias("bottom")).drop("g")
    pages = runs.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("top", "bottom"))).alias("runs"))
    height = lambda r: r["bottom"] - r["top"] + 1
    heights = F.array_sort(F.transform("runs", height))
    pages = pages.withColumn("middle", F.element_at(heights, (F.floor(F.size("runs") / 2) + 1).cast("int")))
    gap = F.greatest(F.lit(1), F.floor(F.col("middle") / 3).cast("int"))

    def merged(lines, run):
        last = F.element_at(lines, -1)
        low = (height(run) * 2 < F.col("middle")) | (height(last) * 2 < F.col("middle"))
        joined = F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.struct(last["top"].alias("top"), run["bottom"].alias("bottom"))))
        return F.when(low & (run["top"] - last["bottom"] - 1 <= gap), joined).otherwise(F.concat(lines, F.array(run)))

    lines = F.aggregate(F.slice("runs", 2, F.size("runs")), F.slice("runs", 1, 1), merged)
    high = F.filter(lines, lambda r: height(r) >= LOWEST)
    return pages.select("image_id", F.posexplode(high).alias("line", "r")).select("image_id", (F.col("line") + 1).alias("line"), "r.top", "r.bottom")


def words(px: DataFrame) -> DataFrame:
    """image_id, line, word (from 1), left, top, right, bottom (ends exclusive) of each word on pages (image_id, y, x, ink).

    Straight rules are left out. Columns of a line that are nearer than two fifths of its height are
    one word; its box is that of its ink. Pages without lines give no rows.
    """
    text = written(without_rules(px).where("ink = 1").select("image_id", "y", "x", "ink"))
    lines = text_lines(text)
    gap = F.greatest(F.lit(WORD_GAP), F.bround((F.col("bottom") - F.col("top") + 1) * GAP_SHARE).cast("int"))
    of_rows = lines.select("image_id", "line", gap.alias("gap"), F.explode(F.sequence("top", "bottom")).alias("y"))
    columns = text.join(of_rows, ["image_id", "y"]).groupBy("image_id", "line", "gap", "x").agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
    along = W.partitionBy("image_id", "line").orderBy("x")
    starts = F.when(F.col("x") - F.lag("x").over(along) - 1 < F.col("gap"), 0).otherwise(1)
    placed = columns.withColumn("starts", starts).withColumn("word", F.sum("starts").over(along).cast("int"))
    return placed.groupBy("image_id", "line", "word").agg(F.min("x").alias("left"), F.min("top").alias("top"), (F.max("x") + 1).alias("right"), (F.max("bottom") + 1).alias("bottom"))
