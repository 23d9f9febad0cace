"""Windows of pixels against plain loops: equalisation, what matters most, resizing by mode, placeholder texts."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterfold.functions import kernels
from rasterfold.operators import crops, geometry, lines, placeholders, windows


def planes(spark, sizes, names, seed=3, most=256):
    draw = np.random.default_rng(seed)
    arrays = [draw.integers(0, most, (len(names), h, w)) for h, w in sizes]
    rows = [(i, y, x, *map(int, p[:, y, x])) for i, p in enumerate(arrays) for y in range(p.shape[1]) for x in range(p.shape[2])]
    return spark.createDataFrame(rows, f"image_id long, y int, x int, {', '.join(f'{n} int' for n in names)}"), arrays


@pytest.mark.parametrize(("tiles", "clip", "band"), [(3, None, 4), (4, 3, 64), (40, 2, 3), (1, 1, 5)])
def test_equalisation_in_windows(spark, tiles, clip, band):
    px, arrays = planes(spark, ((13, 9), (1, 6), (5, 1)), ["l"], most=20)
    got = {(r["image_id"], r["y"], r["x"]): r["new"] for r in windows.equalize_sliding(px, tiles, clip, band=band).collect()}
    for i, (p,) in enumerate(arrays):
        h, w = p.shape
        hy, hx = max(1, h // min(tiles, h)) // 2, max(1, w // min(tiles, w)) // 2
        for y, x in itertools.product(range(h), range(w)):
            window = p[max(0, y - hy) : y + hy + 1, max(0, x - hx) : x + hx + 1]
            counts = np.bincount(window.ravel(), minlength=256)
            if clip is not None:
                over = int(np.maximum(counts - clip, 0).sum())
                counts = np.minimum(counts, clip) + over // 256 + (np.arange(256) < over % 256)
            last = np.flatnonzero(counts)[-1]
            step = (window.size - counts[last]) / 255
            want = p[y, x] if (counts > 0).sum() <= 1 or step <= 0 else min(255, math.floor((step / 2 + counts[: p[y, x]].sum()) / step))
            assert got[i, y, x] == want


def test_modes_keep_their_sizes(spark):
    px, _ = planes(spark, ((30, 60), (50, 20), (4, 5)), ["l"])
    size = lambda mode, w, h: {r["image_id"]: (r["w"], r["h"], r["n"]) for r in geometry.resize_by_mode(px, mode, w, h, "box", fill={"l": 300}).groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.count("*").alias("n")).collect()}
    assert size("max", 40, 40) == {0: (40, 20, 800), 1: (16, 40, 640), 2: (40, 32, 1280)}
    assert size("min", 10, 10) == {0: (20, 10, 200), 1: (10, 25, 250), 2: (5, 4, 20)}
    assert set(size("crop", 12, 7).values()) == set(size("pad", 12, 7).values()) == set(size("stretch", 12, 7).values()) == {(12, 7, 84)}
    boxed = geometry.resize_by_mode(px, "box_pad", 9, 8, "bicubic", fill={"l": 300}).where("image_id = 2 and l < 300")
    assert {(r["x"], r["y"], r["l"]) for r in boxed.collect()} == {(r["x"] + 2, r["y"] + 2, r["l"]) for r in px.where("image_id = 2").collect()}


def test_the_window_finds_what_matters(spark):
    rows = [(i, y, x, *((200, 30 if (x + y) % 2 else 220, 40) if (bx <= x < bx + 12 and by <= y < by + 12) else (120, 120, 120)), 255) for i, (w, h, bx, by) in enumerate(((90, 30, 60, 8), (90, 30, 4, 8), (30, 90, 8, 70), (600, 200, 480, 100))) for y in range(h) for x in range(w)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int")
    got = {r["image_id"]: (r["x"], r["y"], r["width"], r["height"]) for r in crops.smart_window(px, 1, 1).collect()}
    for i, (bx, by, side) in enumerate(((60, 8, 30), (4, 8, 30), (8, 70, 30), (480, 100, 200))):
        x, y, w, h = got[i]
        assert (w, h) == (side, side) and x <= bx and y <= by and x + w >= bx + 12 and y + h >= by + 12
    boosted = crops.smart_window(px.where("image_id = 0"), 1, 1, boosts=(((0, 0, 20, 30), 5.0),)).first()
    assert boosted["x"] < 20
    flat = crops.smart_window(px.where("image_id = 0").withColumn("a", F.lit(0)), 2, 1).first()
    assert (flat["x"], flat["y"], flat["width"], flat["height"]) == (15, 0, 60, 30)
    assert crops.smart_crop(px.where("image_id < 2"), 8, 8).count() == 128


def test_windows_by_bands_and_by_hand(spark):
    px, arrays = planes(spark, ((70, 100),), list("rgba"), seed=9)
    matters = crops.importance({c: arrays[0][k].astype(float) for k, c in enumerate("rgba")})
    size = 100 / 64
    cells = np.zeros((math.ceil(70 / size), 64))
    for y, x in itertools.product(range(70), range(100)):
        cells[min(len(cells) - 1, int((y + 0.5) / size)), min(63, int((x + 0.5) / size))] += matters[y, x]
    for scale in (1.0, 0.6):
        got = crops.smart_window(px, 3, 2, scale).first()
        assert (got["x"], got["y"], got["width"], got["height"]) == crops.best_window(cells, (100, 70), (3, 2), scale)


def test_placeholder_texts(spark):
    px, arrays = planes(spark, ((9, 14), (3, 2)), list("rgb"), seed=5)
    texts = placeholders.blur_hash(px, 5, 4)
    for r in placeholders.components(texts).collect():
        assert r["valid"] and (r["components_x"], r["components_y"]) == (5, 4) and len(r["hash"]) == 4 + 2 * 20
    light = lambda v: np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    one = {r["image_id"]: r["hash"] for r in placeholders.blur_hash(px, 1, 1).collect()}
    for i, p in enumerate(arrays):
        mean = light(p / 255).mean((1, 2))
        rgb = [int(np.floor(255 * (m * 12.92 if m <= 0.0031308 else 1.055 * m ** (1 / 2.4) - 0.055) + 0.5)) for m in mean]
        value = rgb[0] * 65536 + rgb[1] * 256 + rgb[2]
        assert one[i] == "00" + "".join(placeholders.DIGITS[value // 83**k % 83] for k in (3, 2, 1, 0))
    back = placeholders.from_blur_hash(placeholders.blur_hash(px, 1, 1), 3, 2).collect()
    assert len(back) == 12 and all(placeholders.DIGITS.index(one[r["image_id"]][-1]) == (r["r"] * 65536 + r["g"] * 256 + r["b"]) % 83 for r in back)


@pytest.mark.parametrize("text", [None, "", "L", "00", '00"000', "~00000", "00~~~~", "1000002", "L0" * 14 + "x", "9~~~~~~~"])
def test_texts_that_are_none(spark, text):
    r = placeholders.components(spark.createDataFrame([(1, text)], "image_id long, hash string")).first()
    assert not r["valid"] and r["components_x"] is None
    assert placeholders.from_blur_hash(spark.createDataFrame([(1, text)], "image_id long, hash string"), 2, 2).count() == 0


def test_known_text_gives_known_pixels(spark):
    """A gray text without steps is one colour everywhere; its mean is a known one."""
    text = "L" + "0" + "".join(placeholders.DIGITS[(0x808080) // 83**k % 83] for k in (3, 2, 1, 0)) + "fQ" * 11
    got = placeholders.from_blur_hash(spark.createDataFrame([(1, text)], "image_id long, hash string"), 4, 3).collect()
    assert {(r["r"], r["g"], r["b"]) for r in got} == {(128, 128, 128)}


@pytest.mark.parametrize(("radius", "components", "band"), [(2, 1, 64), (4, 2, 3), (3, 6, 5)])
def test_lens_blur_against_whole_kernels(spark, radius, components, band):
    px, arrays = planes(spark, ((11, 8), (1, 3)), ["l", "a"], seed=7)
    got = {(r["image_id"], r["y"], r["x"]): (r["l"], r["a"]) for r in windows.bokeh_blur(px, radius, components, 2.0, ("l",), "a", band).collect()}
    whole = sum((w * np.outer(t, t)).real for t, w in kernels.bokeh(radius, components))
    assert whole.sum() == pytest.approx(1)
    for i, (p, q) in enumerate(arrays):
        for c, (plane, power) in enumerate(((p, 2.0), (q, 1.0))):
            wide = np.pad((plane / 255) ** power, radius, "edge")
            for y, x in itertools.product(*map(range, plane.shape)):
                v = np.clip((wide[y : y + 2 * radius + 1, x : x + 2 * radius + 1] * whole).sum(), 0, 1) ** (1 / power) * 255
                assert got[i, y, x][c] == math.floor(round(v, 5) + 0.5)


def test_channels_as_one_by_one(spark):
    px, _ = planes(spark, ((7, 9), (2, 3)), list("rgb"), seed=11)
    taps = kernels.taps(((1, 2, 1), (0, 3, 0), (2, 1, 2)))
    both = {(r["image_id"], r["y"], r["x"]): r for r in lines.convolve_channels(px, ("r", "g", "b"), {"k": taps}, keep=True).collect()}
    ranked = {(r["image_id"], r["y"], r["x"]): r for r in lines.rank_channels(px, ("r", "b"), [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], "median").collect()}
    for c in "rgb":
        assert {(r["image_id"], r["y"], r["x"]): r["k"] for r in lines.convolve(px, c, {"k": taps}).collect()} == {k: r[f"{c}_k"] for k, r in both.items()}
    for c in "rb":
        assert {(r["image_id"], r["y"], r["x"]): r["v"] for r in lines.rank_filter(px, c, 1, "median").collect()} == {k: r[c] for k, r in ranked.items()}
