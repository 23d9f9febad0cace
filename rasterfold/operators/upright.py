"""Which way up a page of text is, from its ink alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterfold.operators.analytics import runs
from rasterfold.operators.cut import written
from rasterfold.operators.geometry import turn
from rasterfold.operators.pixels import sized

#: Shortest straight run that is a rule, its least share of the shorter side, empty rows within a line, rows of a line, ink of a page.
RULE, RULE_SHARE, GAP, ROWS, INK = 40, 4, 2, 3, 32


def without_rules(px: DataFrame) -> DataFrame:
    """px (image_id, y, x, ink) without ink in straight runs of a quarter of the shorter side, along or across."""
    page = sized(px)
    sizes = page.select("image_id", F.greatest(F.lit(RULE), F.floor(F.least("width", "height") / RULE_SHARE)).alias("shortest")).distinct()
    cells = lambda found: found.join(sizes, "image_id").where("length >= shortest").select("image_id", "y", F.explode(F.expr("sequence(x, CAST(x + length - 1 AS INT))")).alias("x"))
    along = cells(runs(px))
    across = cells(runs(px.select("image_id", F.col("x").alias("y"), F.col("y").alias("x"), "ink"))).select("image_id", F.col("x").alias("y"), F.col("y").alias("x"))
    rules = along.unionByName(across).distinct().withColumn("rule", F.lit(1))
    return px.select("image_id", "y", "x", "ink").join(rules, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.when(F.col("rule") == 1, 0).otherwise(F.col("ink")).alias("ink"))


def _spread(values: str) -> Column:
    """The mean distance of an array's values from the one in their middle; 0 of fewer than two."""
    middle = F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
    total = F.aggregate(F.transform(values, lambda v: F.abs(v - middle).cast("double")), F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(values) < 2, 0.0).otherwise(total / F.size(values))


def line_cues(px: DataFrame) -> DataFrame:
    """image_id, lineness, asymmetry, lines: how sharply rows of ink alternate with gaps, and what tells the top of lines from their foot.

    Lines are rows of ink with gaps of at most GAP rows, ROWS high at least. More ink above a line's
    core (rows with half of its fullest row's ink) than below it, and right ends more ragged than
    left ones, speak for a page that is upright.
    """
    rows = px.groupBy("image_id", "y").agg(F.sum("ink").cast("long").alias("n"), F.min(F.when(F.col("ink") == 1, F.col("x"))).alias("left"), F.max(F.when(F.col("ink") == 1, F.col("x"))).alias("right"))
    down = W.partitionBy("image_id").orderBy("y")
    change = F.col("n") - F.lag("n").over(down)
    energy = rows.withColumn("change", change).groupBy("image_id").agg(F.sum(F.col("n") * F.col("n")).alias("energy"), F.sum(F.col("change") * F.col("change")).alias("changes"))
    inked = rows.where("n > 0")
    starts = F.when(F.col("y") - F.lag("y").over(down) <= GAP + 1, 0).otherwise(1)
    inked = inked.withColumn("starts", starts).withColumn("line", F.sum("starts").over(down))
    whole = W.partitionBy("image_id", "line")
    inked = inked.withColumn("core", F.col("n") >= F.max("n").over(whole) * 0.5)
    inked = inked.withColumn("first", F.min(F.when(F.col("core"), F.col("y"))).over(whole)).withColumn("last", F.max(F.when(F.col("core"), F.col("y"))).over(whole))
    lines = inked.groupBy("image_id", "line").agg(
        (F.max("y") - F.min("y") + 1).alias("height"), F.sum(F.when(F.col("y") < F.col("first"), F.col("n")).otherwise(0)).alias("above"), F.sum(F.when(F.col("y") > F.col("last"), F.col("n")).otherwise(0)).alias("below"),
        F.min("left").alias("left"), F.max("right").alias("right"),
    ).where(f"height >= {ROWS}")
    pages = lines.groupBy("image_id").agg(F.count("*").alias("lines"), F.sum("above").alias("above"), F.sum("below").alias("below"), F.collect_list("left").alias("lefts"), F.collect_list("right").alias("rights"))
    both = lambda a, b: F.when(a + b > 1e-9, (a - b) / (a + b)).otherwise(0.0)
    cues = pages.select("image_id", "lines", (0.6 * both(F.col("above"), F.col("below")) + 0.4 * both(_spread("rights"), _spread("lefts"))).alias("asymmetry"))
    lineness = F.when(F.col("energy") > 0, F.coalesce("changes", F.lit(0)) / F.col("energy")).otherwise(0.0)
    return energy.join(cues, "image_id", "left").select("image_id", lineness.alias("lineness"), F.coalesce("asymmetry", F.lit(0.0)).alias("asymmetry"), F.coalesce("lines", F.lit(0)).alias("lines"))


def orientation(px: DataFrame) -> DataFrame:
    """image_id, degrees, confidence: by how much (0, 90, 180, 270, clockwise) each page (image_id, y, x, ink) has to be turned to be upright.

    Rules are left out. Text runs the way in which its profile alternates more sharply; asymmetry
    tells the top. Pages with hardly any ink, or mostly ink, stay as they are, with confidence 0.
    Pages are whole rows of ink and paper, straight (see pages.deskew).
    """
    amounts = px.groupBy("image_id").agg(F.sum("ink").alias("ink"), F.count("*").alias("n"))
    text = written(without_rules(px))
    upright = line_cues(text).select("image_id", *(F.col(c).alias(f"{c}0") for c in ("lineness", "asymmetry", "lines")))
    turned = line_cues(turn(text, 90)).select("image_id", *(F.col(c).alias(f"{c}1") for c in ("lineness", "asymmetry", "lines")))
    known = amounts.join(upright, "image_id").join(turned, "image_id")
    flat = F.col("lineness0") >= F.col("lineness1")
    chosen = {c: F.when(flat, F.col(f"{c}0")).otherwise(F.col(f"{c}1")) for c in ("asymmetry", "lines")}
    most, least = F.greatest("lineness0", "lineness1"), F.least("lineness0", "lineness1")
    contrast = F.when(most > 0, (most - least) / (most + least)).otherwise(0.0)
    degrees = F.when(flat, F.when(chosen["asymmetry"] >= 0, 0).otherwise(180)).otherwise(F.when(chosen["asymmetry"] >= 0, 90).otherwise(270))
    sure = F.least(F.lit(1.0), F.abs(chosen["asymmetry"]) * 1.5) * (0.4 + 0.6 * F.least(F.lit(1.0), contrast * 2)) * F.when(chosen["lines"] < 3, 0.3).otherwise(1.0)
    enough = (F.col("ink") >= INK) & (F.col("ink") * 2 <= F.col("n"))
    return known.select("image_id", F.when(enough, degrees).otherwise(0).alias("degrees"), F.when(enough, F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).otherwise(0.0).alias("confidence"))


def upright(px: DataFrame, degrees: DataFrame) -> DataFrame:
    """Pages (image_id, y, x and any channels) turned by their own degrees (image_id, degrees), a multiple of 90."""
    page = sized(px).join(degrees.select("image_id", "degrees"), "image_id")
    x, y, right, low = F.col("x"), F.col("y"), F.col("width") - 1 - F.col("x"), F.col("height") - 1 - F.col("y")
    to_y = F.when(F.col("degrees") == 90, x).when(F.col("degrees") == 180, low).when(F.col("degrees") == 270, right).otherwise(y)
    to_x = F.when(F.col("degrees") == 90, low).when(F.col("degrees") == 180, right).when(F.col("degrees") == 270, y).otherwise(x)
    rest = [c for c in px.columns if c not in ("image_id", "y", "x")]
    return page.select("image_id", to_y.cast("int").alias("y"), to_x.cast("int").alias("x"), *rest)
