"""How like two images are: structural similarity, on one scale and on several."""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterfold.operators.bands import BAND, halved, over_bands

#: Fixed values of the measure: window, its deviation, constants for levels of 0 to 255, and the weights of five scales.
WINDOW, DEVIATION, C1, C2 = 11, 1.5, (0.01 * 255) ** 2, (0.03 * 255) ** 2
WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)
GAUSS = np.array([math.exp(-((i - WINDOW // 2) ** 2) / (2 * DEVIATION**2)) for i in range(WINDOW)])
GAUSS /= GAUSS.sum()


def similarity(px: DataFrame, a: str = "l", b: str = "l2", band: int = BAND) -> DataFrame:
    """image_id, ssim, structure, windows: means over the windows all of whose pixels are there (none: no row).

    Pixels are set at their own places, so lines that end early or have gaps are not filled up.
    """

    def summed(planes: dict[str, np.ndarray], top: int, first: int, height: int) -> dict[str, object]:
        u, v = planes["_u"] - planes["_u"].min(), planes["_v"][:, None] - first
        x, y, there = (np.zeros((int(v.max()) + 1, int(u.max()) + 1), kind) for kind in (np.float64, np.float64, bool))
        x[v, u], y[v, u], there[v, u] = planes[a], planes[b], True
        if x.shape[0] < WINDOW or x.shape[1] < WINDOW:
            return {"ssim": [], "structure": [], "windows": []}
        whole = sliding_window_view(sliding_window_view(there, WINDOW, 1).all(2), WINDOW, 0).all(2)[:band]
        if not whole.any():
            return {"ssim": [], "structure": [], "windows": []}
        signals = np.stack([x, y, x * x, y * y, x * y])
        across = sliding_window_view(signals, WINDOW, 2) @ GAUSS
        mx, my, xx, yy, xy = (sliding_window_view(across, WINDOW, 1) @ GAUSS)[:, :band]
        structure = (2 * (xy - mx * my) + C2) / (xx - mx * mx + yy - my * my + C2)
        likeness = structure * (2 * mx * my + C1) / (mx * mx + my * my + C1)
        return {"ssim": [likeness[whole].sum()], "structure": [structure[whole].sum()], "windows": [int(whole.sum())]}

    sums = over_bands(px, [a, b], 0, WINDOW - 1, summed, "ssim double, structure double, windows long", band, placed=True)
    n = F.sum("windows")
    return sums.groupBy("image_id").agg((F.sum("ssim") / n).alias("ssim"), (F.sum("structure") / n).alias("structure"), n.alias("windows"))


def multi_scale(px: DataFrame, a: str = "l", b: str = "l2") -> DataFrame:
    """image_id, ms_ssim: the structure of four scales and the similarity of the fifth, each to its weight; null for images too small for a window on all five."""
    scale, terms = px.select("image_id", "y", "x", a, b), None
    for k in range(len(WEIGHTS)):
        found = similarity(scale, a, b).select("image_id", F.lit(k).alias("scale"), F.greatest(F.lit(0.0), F.col("ssim" if k == len(WEIGHTS) - 1 else "structure")).alias("term"))
        terms = found if terms is None else terms.unionByName(found)
        scale = halved(scale, a, b)
    term = [F.pow(F.max(F.when(F.col("scale") == k, F.col("term"))), F.lit(w)) for k, w in enumerate(WEIGHTS)]
    product = term[0]
    for t in term[1:]:
        product = product * t
    known = terms.groupBy("image_id").agg(product.alias("ms_ssim"))
    return px.select("image_id").distinct().join(known, "image_id", "left")
