"""Pages of ink: specks, holes, borders and rules, skew, thinning, and equalisation by tiles.

A page is a set of rows (image_id, y, x, ink) with ink 1 and paper 0, whole from the first line to the last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterfold.functions.numbers import byte
from rasterfold.operators.analytics import label_components, runs
from rasterfold.operators.pixels import sized


def components(px: DataFrame, of_paper: bool = False) -> DataFrame:
    """image_id, y, x, label and area, left, right, top, bottom of its component: of ink (8 neighbours) or of paper (4)."""
    marked = label_components(px.withColumn("ink", 1 - F.col("ink")) if of_paper else px, 4 if of_paper else 8)
    stats = marked.groupBy("image_id", "label").agg(F.count("*").alias("area"), F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    return marked.join(stats, ["image_id", "label"])


def _painted(px: DataFrame, spots: DataFrame, ink: int) -> DataFrame:
    """px with the spots (image_id, y, x) made ink or paper."""
    return px.join(spots.select("image_id", "y", "x", F.lit(ink).alias("_ink")), ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.coalesce("_ink", "ink").alias("ink"))


def _touches() -> Column:
    return (F.col("left") == 0) | (F.col("top") == 0) | (F.col("right") == F.col("width") - 1) | (F.col("bottom") == F.col("height") - 1)


def _with_size(parts: DataFrame, px: DataFrame) -> DataFrame:
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return parts.join(sizes, "image_id")


def fill_holes(px: DataFrame) -> DataFrame:
    """Paper that ink encloses (no way of 4 neighbours to the border) becomes ink."""
    return _painted(px, _with_size(components(px, True), px).where(~_touches()), 1)


def despeckle(px: DataFrame, most: int) -> DataFrame:
    """Components of ink of at most that many pixels go, and such specks of paper are inked; both are judged on the page as it came."""
    ink, paper = components(px).where(F.col("area") <= most), components(px, True).where(F.col("area") <= most)
    return _painted(_painted(px, ink, 0), paper, 1)


def remove_borders(px: DataFrame) -> DataFrame:
    """Components of ink at the border go if they have a hundredth of the page or span half of a side."""
    parts = _with_size(components(px), px)
    large = (F.col("area") >= 0.01 * F.col("width") * F.col("height")) | (F.col("right") - F.col("left") + 1 >= 0.5 * F.col("width")) | (F.col("bottom") - F.col("top") + 1 >= 0.5 * F.col("height"))
    return _painted(px, parts.where(_touches() & large), 0)


def remove_lines(px: DataFrame, shortest: int, reach: int = 2) -> DataFrame:
    """Runs of ink along lines of at least that length go, except where ink within reach on both sides crosses them."""
    long = runs(px).where(F.col("length") >= shortest)
    cells = long.select("image_id", "y", F.explode(F.expr("sequence(x, CAST(x + length - 1 AS INT))")).alias("x"), F.lit(1).alias("rule"))
    ink = px.where("ink = 1").join(cells, ["image_id", "y", "x"], "left").withColumn("rule", F.coalesce("rule", F.lit(0)))
    column = W.partitionBy("image_id", "x").orderBy("y")
    stroke = F.col("rule") == 0
    above, below = (F.coalesce(F.max(stroke).over(column.rangeBetween(*r)), F.lit(False)) for r in ((-reach, -1), (1, reach)))
    ink = ink.withColumns({"above": above, "below": below}).where("rule = 1")
    ink = ink.withColumn("band", F.col("y") - F.row_number().over(column))
    whole = W.partitionBy("image_id", "x", "band")
    crossed = F.max_by("below", "y").over(whole) & F.min_by("above", "y").over(whole)
    return _painted(px, ink.withColumn("crossed", crossed).where("not crossed"), 0)


def dark_margins(px: DataFrame, share: float = 0.5, most: float = 0.15) -> DataFrame:
    """image_id, left, top, right, bottom (ends exclusive) without outer lines that are mostly ink, at most 15 % of each side.

    Columns are judged over the whole height, then lines between the columns that stay.
    """
    page = sized(px)
    columns = page.groupBy("image_id", "width", "height", "x").agg(F.sum("ink").alias("n"))
    light = F.col("n") < share * F.col("height")
    room = F.floor(F.col("width") * most)
    sides = columns.groupBy("image_id", "width", "height").agg(F.min(F.when(light, F.col("x"))).alias("first"), F.max(F.when(light, F.col("x"))).alias("last"))
    sides = sides.select("image_id", "height", F.least(room, F.coalesce("first", "width")).cast("int").alias("left"), F.greatest(F.col("width") - F.greatest(room - 1, F.lit(0)), F.coalesce("last", F.lit(-1)) + 1).cast("int").alias("right"))
    inner = px.join(sides, "image_id").where("x >= left and x < right")
    lines = inner.groupBy("image_id", "height", "left", "right", "y").agg(F.sum("ink").alias("n"))
    light, room = F.col("n") < share * (F.col("right") - F.col("left")), F.floor(F.col("height") * most)
    ends = lines.groupBy("image_id", "height", "left", "right").agg(F.min(F.when(light, F.col("y"))).alias("first"), F.max(F.when(light, F.col("y"))).alias("last"))
    return ends.select("image_id", "left", F.least(room, F.coalesce("first", "height")).cast("int").alias("top"), "right", F.greatest(F.col("height") - F.greatest(room - 1, F.lit(0)), F.coalesce("last", F.lit(-1)) + 1).cast("int").alias("bottom"))


def _energy(points: DataFrame, angles: Column) -> DataFrame:
    """image_id, step, energy: the sum of squares of how many points share a line of that direction."""
    tilted = points.select("image_id", "x", "y", F.explode(angles).alias("step"))
    radians = F.radians(F.col("step") / 100)
    line = F.floor(F.round(F.col("y") * F.cos(radians) - F.col("x") * F.sin(radians), 6) + 0.5)
    return tilted.groupBy("image_id", "step", line.alias("line")).agg(F.count("*").alias("n")).groupBy("image_id", "step").agg(F.sum(F.col("n") * F.col("n")).alias("energy"))


def _strongest(energy: DataFrame) -> DataFrame:
    """The strongest step of each page; of equal ones that nearest to upright, then the lower."""
    return energy.groupBy("image_id").agg(F.max(F.struct("energy", (-F.abs("step")).alias("near"), (-F.col("step")).alias("minus"))).alias("m")).select("image_id", (-F.col("m.minus")).cast("int").alias("step"), "m.energy")


def skew(px: DataFrame, most: int = 15) -> DataFrame:
    """image_id, degrees, energy: the direction in which the lower edges of the ink line up best.

    Degrees from -most to most are tried by halves, then by twentieths around the best.
    Only counts by direction and line are shuffled.
    """
    below = F.lead("ink").over(W.partitionBy("image_id", "x").orderBy("y"))
    points = px.select("image_id", "y", "x", "ink", F.coalesce(below, F.lit(0)).alias("below")).where("ink = 1 and below = 0").select("image_id", "y", "x")
    coarse = _strongest(_energy(points, F.sequence(F.lit(-100 * most), F.lit(100 * most), F.lit(50))))
    around = points.join(coarse.select("image_id", F.col("step").alias("at")), "image_id").withColumn("steps", F.sequence(F.col("at") - 60, F.col("at") + 60, F.lit(5)))
    fine = _strongest(_energy(around, F.col("steps")))
    return fine.select("image_id", (F.col("step") / 100).alias("degrees"), "energy")


def deskew(px: DataFrame, degrees: DataFrame, value: str = "ink", fill: int = 0) -> DataFrame:
    """Pages turned back by their own degrees (image_id, degrees) around the middle, nearest pixels; the size stays."""
    page = sized(px).join(degrees.select("image_id", "degrees"), "image_id")
    c, s = F.cos(F.radians("degrees")), F.sin(F.radians("degrees"))
    mx, my = (F.col("width") - 1) / 2, (F.col("height") - 1) / 2
    dx, dy = F.col("x") - mx, F.col("y") - my
    nearest = lambda e: F.floor(F.round(e, 6) + 0.5).cast("int")
    asked = page.select("image_id", "y", "x", nearest(my + dx * s + dy * c).alias("_y"), nearest(mx + dx * c - dy * s).alias("_x"))
    given = px.select("image_id", F.col("y").alias("_y"), F.col("x").alias("_x"), value)
    return asked.join(given, ["image_id", "_y", "_x"], "left").select("image_id", "y", "x", F.coalesce(F.col(value), F.lit(fill)).alias(value))


def thinned(ink: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning of an array of ink; its outermost pixels are left alone."""
    ink = ink.astype(bool)
    changed = True
    while changed:
        changed = False
        for turn in (0, 1):
            shift = lambda dy, dx: ink[1 + dy : ink.shape[0] - 1 + dy, 1 + dx : ink.shape[1] - 1 + dx]
            ring = [shift(-1, 0), shift(-1, 1), shift(0, 1), shift(1, 1), shift(1, 0), shift(1, -1), shift(0, -1), shift(-1, -1)]
            n = sum(x.astype(np.int8) for x in ring)
            rises = sum((~a & b).astype(np.int8) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
            up, right, down, left = ring[0], ring[2], ring[4], ring[6]
            spared = (up & right & down) | (right & down & left) if turn == 0 else (up & right & left) | (up & down & left)
            gone = shift(0, 0) & (n >= 2) & (n <= 6) & (rises == 1) & ~spared
            if gone.any():
                ink[1:-1, 1:-1] &= ~gone
                changed = True
    return ink


def thin(px: DataFrame) -> DataFrame:
    """Strokes one pixel wide. The passes go on until nothing changes, so a page is one task's work, in whole arrays."""

    def by_page(rows: pd.DataFrame) -> pd.DataFrame:
        page = np.zeros((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1), bool)
        page[rows["y"], rows["x"]] = rows["ink"] == 1
        return rows.assign(ink=(thinned(page) if min(page.shape) > 2 else page)[rows["y"], rows["x"]].astype(np.int32))

    return px.select("image_id", "y", "x", "ink").groupBy("image_id").applyInPandas(by_page, px.select("image_id", "y", "x", "ink").schema)


def equalize_adaptive(px: DataFrame, tiles_y: int, tiles_x: int, clip: int | None = None) -> DataFrame:
    """Levels by their rank in the tiles around: clipped histograms, and mappings blended between the four nearest middles.

    What a histogram has above clip is dealt evenly over all 256 levels. Only tables of levels are
    shuffled besides the pixels.
    """
    page = sized(px)
    edge = lambda i, side, n: F.floor(i * F.col(side) / n)
    tile = lambda at, side, n: F.floor(((F.col(at) + 1) * n - 1) / F.col(side)).cast("int")
    rows, columns = F.least(F.lit(tiles_y), F.col("height")), F.least(F.lit(tiles_x), F.col("width"))
    cells = page.groupBy("image_id", tile("y", "height", rows).alias("v"), tile("x", "width", columns).alias("u"), "l").agg(F.count("*").alias("n"))
    histogram = cells.groupBy("image_id", "v", "u").agg(F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("h"))  # 256 levels at most
    counts = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.element_at("h", i), F.lit(0).cast("long")))
    tables = histogram.select("image_id", "v", "u", counts.alias("h"))
    if clip is not None:
        total = lambda f: F.aggregate(F.transform("h", f), F.lit(0).cast("long"), lambda a, b: a + b)
        tables = tables.withColumn("over", total(lambda n: F.greatest(n - clip, F.lit(0).cast("long"))))
        shared = F.transform("h", lambda n, i: F.least(n, F.lit(clip).cast("long")) + F.floor(F.col("over") / 256) + F.when(i < F.col("over") % 256, 1).otherwise(0))
        tables = tables.withColumn("h", shared)
    sums = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"] + n)).alias("all")), lambda a: a["all"])
    tables = tables.withColumn("upto", sums).withColumn("least", F.element_at(F.filter("upto", lambda n: n > 0), 1))
    whole = F.element_at("upto", 256)
    lut = F.transform("upto", lambda n, i: F.when(whole == F.col("least"), i.cast("double")).otherwise(F.greatest(F.lit(0.0), (n - F.col("least")) * F.lit(255.0) / (whole - F.col("least")))))
    tables = tables.select("image_id", "v", "u", lut.alias("lut"))

    def near(at: str, side: str, n: Column) -> Column:
        """The one or two tiles whose middles are nearest along an axis, with their weights."""
        middle = lambda i: (edge(i, side, n) + edge(i + 1, side, n)) / 2 - 0.5
        below = F.filter(F.sequence(F.lit(0), n - 1), lambda i: middle(i) <= F.col(at))
        low = F.size(below) - 1
        share = (F.col(at) - middle(low)) / (middle(low + 1) - middle(low))
        one = lambda i: F.array(F.struct(i.cast("int").alias("t"), F.lit(1.0).alias("w")))
        return F.when(low < 0, one(F.lit(0))).when(low >= n - 1, one(n - 1)).otherwise(F.array(F.struct(low.cast("int").alias("t"), (1 - share).alias("w")), F.struct((low + 1).cast("int").alias("t"), share.alias("w"))))

    asked = page.select("image_id", "y", "x", "l", F.explode(near("y", "height", rows)).alias("a"), near("x", "width", columns).alias("b")).withColumn("b", F.explode("b"))
    asked = asked.select("image_id", "y", "x", "l", F.col("a.t").alias("v"), F.col("b.t").alias("u"), (F.col("a.w") * F.col("b.w")).alias("w"))
    mapped = asked.join(tables, ["image_id", "v", "u"]).groupBy("image_id", "y", "x").agg(F.sum(F.col("w") * F.element_at("lut", F.col("l") + 1)).alias("s"))
    return mapped.selectExpr("image_id", "y", "x", f"{byte('round(s, 6)')} AS l")
