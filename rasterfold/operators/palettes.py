"""Palettes made from an image's own colours, and pixels matched to them.

Pixels are counted by colour cells first, so that only tables of cells (a bounded number an image)
are cut or merged; then every pixel meets its image's palette in one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterfold.operators.pixels import with_own

#: Pixels of less alpha are transparent: they take no part in palettes and get one entry of their own.
CUTOFF = 64
#: Levels of a tree of colours: one for each bit.
DEPTH = 8
_SIDE = 33


def _budget(px: DataFrame, colors: int, cutoff: int) -> DataFrame:
    """image_id, budget: how many opaque colours the palette may have."""
    return px.groupBy("image_id").agg((F.lit(colors) - F.max(F.when(F.col("a") < cutoff, 1).otherwise(0))).alias("budget"))


def _cut(moments: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, int] | None:
    """Axis and place where the box (low, high] falls apart best: the largest sum of squares over weight of both sides."""
    best: tuple[float, int, int] | None = None
    for axis in range(3):
        others = [k for k in range(3) if k != axis]
        faces = np.moveaxis(moments, axis, 0)
        (a, b), (c, d) = ((low[k], high[k]) for k in others)
        below = faces[:, b, d] - faces[:, a, d] - faces[:, b, c] + faces[:, a, c]
        half = below[low[axis] + 1 : high[axis]] - below[low[axis]]
        rest = below[high[axis]] - below[low[axis]] - half
        able = np.flatnonzero((half[:, 0] > 0) & (rest[:, 0] > 0))
        if len(able):
            gain = sum((x[able, 1:4].astype(np.float64) ** 2).sum(1) / x[able, 0] for x in (half, rest))
            at = int(np.argmax(gain))
            if best is None or gain[at] > best[0]:
                best = (float(gain[at]), axis, int(low[axis] + 1 + able[at]))
    return best and best[1:]


def _within(moments: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The moments of the box (low, high]."""
    m = moments[:, :, [low[2], high[2]]][:, [low[1], high[1]]][[low[0], high[0]]]
    return np.diff(np.diff(np.diff(m, axis=0), axis=1), axis=2)[0, 0, 0]


def wu_boxes(cells: np.ndarray, budget: int) -> np.ndarray:
    """Mean colours (n, 3) of at most budget boxes, from rows (r, g, b of a cell from 0 to 31; n, sums of r, g, b, sum of squares).

    The box of the largest variance is cut where it falls apart best (of equal cuts: red, green,
    blue, then the lower place) until the budget is used or no box has any variance left.
    """
    table = np.zeros((_SIDE, _SIDE, _SIDE, 5), np.int64)
    table[tuple(cells[:, :3].T + 1)] = cells[:, 3:]
    moments = table.cumsum(0).cumsum(1).cumsum(2)

    def variance(low: np.ndarray, high: np.ndarray) -> float:
        n, r, g, b, squares = _within(moments, low, high).astype(np.float64)
        return squares - (r * r + g * g + b * b) / n if n and (high - low).prod() > 1 else 0.0

    boxes = [(np.zeros(3, np.int64), np.full(3, _SIDE - 1))]
    spread = [variance(*boxes[0])]
    while len(boxes) < budget and max(spread) > 0:
        k = int(np.argmax(spread))
        low, high = boxes[k]
        cut = _cut(moments, low, high)
        if cut is None:
            spread[k] = 0.0
            continue
        axis, at = cut
        middle_high, middle_low = high.copy(), low.copy()
        middle_high[axis] = middle_low[axis] = at
        boxes[k] = (low, middle_high)
        boxes.append((middle_low, high))
        spread[k] = variance(*boxes[k])
        spread.append(variance(*boxes[-1]))
    sums = np.array([_within(moments, *b) for b in boxes])
    n = sums[:, :1]
    return ((sums[:, 1:4] + n // 2) // np.maximum(n, 1))[n[:, 0] > 0]


def wu_palette(px: DataFrame, colors: int, cutoff: int = CUTOFF) -> DataFrame:
    """image_id, entry, r, g, b: at most so many colours for each image (one less where it has transparent pixels).

    Cells of 8 levels a side are counted with partial aggregates: 32,768 rows an image at most,
    whatever its size, and these alone are gathered for the cuts. Images without opaque pixels have
    no entries.
    """
    opaque = px.where(F.col("a") >= cutoff)
    square = sum((F.col(c) * F.col(c) for c in "rgb"), F.lit(0)).cast("long")
    cells = opaque.groupBy("image_id", *(F.expr(f"{c} div 8").cast("long").alias(f"cell_{c}") for c in "rgb")).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in "rgb"), F.sum(square).alias("squares"))
    columns = [*(f"cell_{c}" for c in "rgb"), "n", *(f"sum_{c}" for c in "rgb"), "squares"]

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        found = wu_boxes(rows[columns].to_numpy(np.int64), int(rows["budget"].iloc[0]))
        return pd.DataFrame({"image_id": rows["image_id"].iloc[0], "entry": np.arange(len(found), dtype=np.int32)} | {c: found[:, k].astype(np.int32) for k, c in enumerate("rgb")})

    kind = px.schema["image_id"].dataType.simpleString()
    return cells.join(_budget(px, colors, cutoff), "image_id").groupBy("image_id").applyInPandas(cut, f"image_id {kind}, entry int, r int, g int, b int")


def _code(depth: int) -> str:
    """The bits of r, g and b down to a depth, interleaved from the highest on."""
    return " + ".join(f"((r div {1 << 7 - k} % 2) * 4 + (g div {1 << 7 - k} % 2) * 2 + b div {1 << 7 - k} % 2) * {8 ** (depth - 1 - k)}L" for k in range(depth))


def octree_palette(px: DataFrame, colors: int, cutoff: int = CUTOFF) -> DataFrame:
    """image_id, entry, r, g, b: colours of a tree whose nodes are merged from the deepest level up, the least used first.

    A node is a prefix of the interleaved bits of its colours; while there are too many leaves, a
    node one level up makes its children one leaf. Levels whose nodes are still too many are merged
    as a whole, so one roll-up of all prefixes tells the level where merging ends; there the nodes
    go by their number of pixels (then by prefix), and a running sum says which are merged. Entries
    are in the order of the prefixes, means rounded half up.
    """
    sums = ["n", *(f"sum_{c}" for c in "rgb")]
    opaque = px.where(F.col("a") >= cutoff)
    colours = opaque.groupBy("image_id", F.expr(_code(DEPTH)).alias("code")).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in "rgb"))
    shift = F.expr(f"element_at(array({', '.join(f'{8 ** (DEPTH - d)}L' for d in range(1, DEPTH + 1))}), depth)")
    levels = colours.withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(DEPTH)))).withColumn("code", F.floor(F.col("code") / shift))
    nodes = levels.groupBy("image_id", "depth", "code").agg(*(F.sum(c).alias(c) for c in sums))

    numbers = nodes.groupBy("image_id").agg(F.array(*(F.count_if(F.col("depth") == d) for d in range(1, DEPTH + 1))).alias("nodes")).join(_budget(px, colors, cutoff), "image_id")
    enough = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(DEPTH)), lambda d: (d == 1) | (F.element_at("nodes", d) <= F.col("budget"))))
    numbers = numbers.select("image_id", F.least(F.lit(DEPTH), enough + 1).alias("depth"), "nodes", "budget")
    numbers = numbers.select("image_id", "depth", (F.element_at("nodes", F.col("depth")) - F.col("budget")).alias("excess"))
    leaves = nodes.join(numbers, ["image_id", "depth"]).withColumn("up", F.floor(F.col("code") / 8))
    parents = leaves.groupBy("image_id", "up", "depth", "excess").agg(*(F.sum(c).alias(c) for c in sums), F.count("*").alias("children"))
    before = W.partitionBy("image_id").orderBy("n", "up").rowsBetween(W.unboundedPreceding, -1)
    parents = parents.withColumn("merged", F.coalesce(F.sum(F.col("children") - 1).over(before), F.lit(0)) < F.col("excess"))
    whole = parents.where("merged").select("image_id", F.col("up").alias("code"), (F.col("depth") - 1).alias("depth"), *sums)
    stay = leaves.join(parents.where("not merged").select("image_id", "up"), ["image_id", "up"]).select("image_id", "code", "depth", *sums)
    place = W.partitionBy("image_id").orderBy(F.col("code") * shift)
    return whole.unionByName(stay).select("image_id", (F.row_number().over(place) - 1).alias("entry"), *(F.expr(f"(sum_{c} + n div 2) div n").cast("int").alias(c) for c in "rgb"))


def matched(px: DataFrame, palette: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """px (image_id, y, x, r, g, b, a) with each opaque pixel as the nearest entry of its image's palette, of equal ones the first.

    Transparent pixels are all 0. Palettes (image_id, entry, r, g, b) have a bounded number of
    entries; each is one row that meets its image's pixels line by line.
    """
    whole = palette.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("entry", "r", "g", "b"))).alias("palette"))
    far = lambda p: sum(((p[c] - F.col(c)) * (p[c] - F.col(c)) for c in "rgb"), F.lit(0))
    nearest = F.array_min(F.transform("palette", lambda p: F.struct(far(p).alias("far"), p["entry"].alias("entry"), *(p[c].alias(c) for c in "rgb"))))
    both = with_own(px.select("image_id", "y", "x", *"rgba"), whole, "left").withColumn("best", nearest)
    clear = F.col("a") < cutoff
    return both.select("image_id", "y", "x", *(F.when(clear, 0).otherwise(F.col(f"best.{c}")).alias(c) for c in "rgb"), F.when(clear, 0).otherwise(255).alias("a"))
