"""Values worked out by hand or by plain loops, for operators whose SQL says the same as they do."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterfold.functions import color, kernels
from rasterfold.operators import analytics, compose, geometry, luts, pages, tensors
from rasterfold.plans import catalog


@pytest.fixture(scope="module")
def pixel(spark):
    def make(r, g, b, a=255, x=0, y=0, **more):
        return spark.createDataFrame([(1, y, x, r, g, b, a, *more.values())], ", ".join(["image_id long, y int, x int, r int, g int, b int, a int", *(f"{k} double" for k in more)]))

    return make


def first(frame, channels):
    return [frame.selectExpr(f"{e} AS v").first()["v"] for e in channels.values()]


#: Matrix, pixel, and what comes out.
FILTERED = (
    (color.MATRICES["achromatopsia"], (200, 100, 50), (124, 124, 124)), (color.grayscale_matrix(1, "bt601"), (200, 100, 50), (124, 124, 124)), (color.grayscale_matrix(1), (255, 0, 0), (54, 54, 54)), (color.scale_matrix(1.5), (100, 200, 10), (150, 255, 15)),
    (color.contrast_matrix(1.5), (100, 200, 255), (86, 236, 255)), (color.invert_matrix(1), (0, 100, 255), (255, 155, 0)), (color.saturate_matrix(1), (12, 34, 56), (12, 34, 56)), (color.saturate_matrix(0), (255, 255, 255), (255, 255, 255)),
    (color.lightness_matrix(1.2), (100, 0, 250), (151, 51, 255)), (color.hue_matrix(0), (10, 20, 30), (10, 20, 30)), (color.sepia_matrix(1), (255, 255, 255), (255, 255, 239)), (color.MATRICES["black_white"], (10, 10, 10), (0, 0, 0)),
)


@pytest.mark.parametrize(("matrix", "given", "wanted"), FILTERED)
def test_matrices(pixel, matrix, given, wanted):
    out = color.apply_matrix(matrix)
    assert first(pixel(*given), {c: out[c] for c in "rgb"}) == list(wanted)


def test_colour_spaces(pixel):
    close = lambda got, want, by=1e-3: np.allclose(got, want, atol=by)
    red, white, teal = pixel(255, 0, 0), pixel(255, 255, 255), pixel(0, 128, 128)
    assert close(first(white, color.xyz()), [0.95047, 1.0, 1.08883]) and close(first(red, color.xyz()), [0.41246, 0.21267, 0.01933])
    assert close(first(red, color.lab()), [53.2408, 80.0925, 67.2032], 0.01) and close(first(white, color.lab()), [100, 0, 0], 0.01)
    assert close(first(red, color.lch()), [53.2408, 104.5518, 39.999], 0.01)
    assert close(first(red, color.oklab()), [0.62796, 0.22486, 0.12585]) and close(first(white, color.oklab()), [1, 0, 0])
    assert close(first(red, color.hsv()), [0, 1, 1]) and close(first(teal, color.hsv()), [180, 1, 128 / 255]) and close(first(pixel(255, 0, 128), color.hsv()), [329.882, 1, 1])
    assert close(first(teal, color.hsl()), [180, 1, 64 / 255]) and close(first(pixel(255, 128, 128), color.hsl()), [0, 1, 0.75098])
    assert close(first(pixel(188, 0, 10), {c: color.linear(c) for c in "rgb"}), [0.50289, 0, 0.0030353])
    d50 = pixel(0, 0, 0, cie_x=0.95047, cie_y=1.0, cie_z=1.08883)
    assert close(first(d50, color.adapted()), [0.96422, 1, 0.82521], 1e-4)
    assert first(pixel(0, 0, 0, h=210.0, s=0.5, v=0.8), color.from_hsv()) == [102, 153, 204] and first(pixel(0, 0, 0, h=30.0, s=1.0, l=0.5), color.from_hsl()) == [255, 128, 0]


@pytest.mark.parametrize(("curve", "given", "wanted"), [("clip", 128, 128), ("clip", 255, 255), ("reinhard", 255, 188), ("reinhard", 0, 0), ("aces", 0, 0), ("hable", 0, 0)])
def test_tone_curves(pixel, curve, given, wanted):
    out = color.tone_map(curve, 0)
    assert first(pixel(given, given, given), {c: out[c] for c in "rgb"}) == [wanted] * 3


#: Mode, backdrop, source, and the blend of opaque colours.
BLENDED = (
    ("normal", 10, 200, 200), ("multiply", 128, 128, 64), ("add", 200, 100, 255), ("subtract", 100, 150, 0), ("screen", 128, 128, 192), ("darken", 10, 200, 10), ("lighten", 10, 200, 200), ("overlay", 64, 128, 64), ("overlay", 192, 128, 192),
    ("hard_light", 128, 64, 64), ("color_dodge", 100, 255, 255), ("color_burn", 100, 0, 0), ("color_burn", 255, 0, 255), ("difference", 10, 200, 190), ("exclusion", 255, 255, 0), ("soft_light", 128, 0, 64),
)


@pytest.mark.parametrize(("mode", "below", "above", "wanted"), BLENDED)
def test_blends(pixel, mode, below, above, wanted):
    got = compose.draw(pixel(below, below, below), pixel(above, above, above), blend=mode).first()
    assert abs(got["r"] - wanted) <= 1 and got["a"] == 255


def test_compositions(pixel):
    half = pixel(200, 200, 200, 128)
    alpha = {m: compose.draw(pixel(0, 0, 0, 128), half, composition=m).first()["a"] for m in color.COMPOSITIONS}
    both, one, other = round(255 * (1 - (1 - 128 / 255) ** 2)), 128, round(128 * 128 / 255)
    assert alpha == {"src": one, "dest": one, "clear": 0, "src_over": both, "dest_over": both, "src_atop": one, "dest_atop": one, "src_in": other, "dest_in": other, "src_out": one - other, "dest_out": one - other, "xor": round(2 * 128 * 127 / 255)}
    assert compose.draw(pixel(0, 0, 0), pixel(255, 255, 255), opacity=0.5).first()["r"] == 128


def array(spark, levels, channel="l"):
    return spark.createDataFrame([(1, y, x, int(v)) for (y, x), v in np.ndenumerate(levels)], f"image_id long, y int, x int, {channel} int")


def levels(frame, channel="l"):
    rows = frame.collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), -1)
    for r in rows:
        out[r["y"], r["x"]] = r[channel]
    return out


def test_resize(spark):
    ramp = np.tile(np.arange(0, 240, 20), (4, 1))
    assert (levels(geometry.resize(array(spark, ramp), 6, 2, "box")) == np.tile(np.arange(10, 240, 40), (2, 1))).all()
    assert (levels(geometry.resize(array(spark, ramp), 12, 4, "bicubic")) == ramp).all() and (levels(geometry.resize(array(spark, np.full((3, 5), 77)), 200, 130, "lanczos3")) == 77).all()
    draw = np.random.default_rng(1)
    tall = draw.integers(0, 256, (300, 3))
    for sampler in ("triangle", "lanczos3"):
        weights = np.zeros((150, 300))
        for t, s, w in kernels.axis_taps(300, 150, sampler):
            weights[t, s] = w
        want = np.clip(np.floor(np.round(weights @ tall, 6) + 0.5), 0, 255)
        assert (levels(geometry.resize(array(spark, tall), 3, 150, sampler)) == want).all()  # in bands
    clear = spark.createDataFrame([(1, 0, 0, 255, 255), (1, 0, 1, 0, 0)], "image_id long, y int, x int, r int, a int")
    assert tuple(geometry.resize(clear, 1, 1, "box", ("r", "a"), alpha="a").first()[3:]) == (255, 128) and tuple(geometry.resize(clear, 1, 1, "box", ("r", "a")).first()[3:]) == (128, 128)
    assert geometry.resize(array(spark, [[0, 255]]), 1, 1, "box", linear=True).first()["l"] == 188


def test_sizes(spark):
    sizes = spark.createDataFrame([(400, 200), (50, 40)], "width int, height int")
    plan = lambda *a, **k: [tuple(r) for r in sizes.select(*(c.alias(n) for n, c in geometry.fitted(*a, **k).items())).collect()]
    assert plan("stretch", 100, 80) == [(100, 80, 100, 80, 0, 0)] * 2 and plan("max", 100, 80) == [(100, 50, 100, 50, 0, 0), (100, 80, 100, 80, 0, 0)]
    assert plan("min", 100, 80) == [(160, 80, 160, 80, 0, 0), (50, 40, 50, 40, 0, 0)] and plan("crop", 100, 80) == [(100, 80, 160, 80, -30, 0), (100, 80, 100, 80, 0, 0)]
    assert plan("pad", 100, 80, anchor="bottom_right")[0] == (100, 80, 100, 50, 0, 30) and plan("box_pad", 100, 80)[1] == (100, 80, 50, 40, 25, 20)


def test_orientations(spark):
    upright = np.array([[1, 2, 3], [4, 5, 6]])
    stored = {1: upright, 2: upright[:, ::-1], 3: upright[::-1, ::-1], 4: upright[::-1], 5: upright.T, 6: np.rot90(upright), 7: upright[::-1, ::-1].T, 8: np.rot90(upright, -1)}
    for tag, levels_of in stored.items():
        assert (levels(geometry.orient(array(spark, levels_of), F.lit(tag))) == upright).all(), tag
    assert (levels(geometry.turn(array(spark, upright), 90)) == np.rot90(upright, -1)).all() and (levels(geometry.flip(array(spark, upright), "vertical")) == upright[::-1]).all()
    assert (levels(geometry.crop(array(spark, upright), (1, 0, 2, 2))) == upright[:, 1:]).all() and levels(geometry.place(array(spark, upright), 5, 4, (1, 1), {"l": 9})).sum() == 21 + 9 * 14


def test_tensors(spark):
    px = spark.createDataFrame([(1, 0, 0, 255, 0, 51), (1, 0, 1, 102, 204, 0)], "image_id long, y int, x int, r int, g int, b int")
    assert np.allclose(tensors.to_tensor(px).first()["tensor"], [1, 0.4, 0, 0.8, 0.2, 0]) and np.allclose(tensors.to_tensor(px, "hwc", tuple("bgr"), (0.5,) * 3, (0.5,) * 3).first()["tensor"], [-0.6, -1, 1, -1, 0.6, -0.2])
    assert sorted(map(tuple, tensors.from_tensor(tensors.to_tensor(px)).collect())) == sorted(map(tuple, px.collect()))


def test_tables_of_colours(spark, pixel):
    lut = luts.parse_cube('# note\nTITLE "two"\nLUT_3D_SIZE 2\n' + "\n".join(f"{1 - r} {g} {b * 0.5}" for b in (0, 1) for g in (0, 1) for r in (0, 1)))
    for way in ("trilinear", "tetrahedral"):
        assert tuple(luts.apply(pixel(255, 51, 102), lut, way).select("r", "g", "b").first()) == (0, 51, 51)
    assert lut["title"] == "two" and luts.parse_cube("LUT_1D_SIZE 2\n0 0 0\n1 1 1")["dimensions"] == 1
    with pytest.raises(ValueError, match="8 entries"):
        luts.parse_cube("LUT_3D_SIZE 2\n0 0 0")


@pytest.mark.parametrize("name", sorted(kernels.DIFFUSIONS))
def test_diffusion(name):
    divisor, weights = kernels.DIFFUSIONS[name]
    assert sum(w for _, _, w in weights) <= divisor
    draw = np.random.default_rng(3)
    for shape in ((12, 40), (1, 9), (7, 1), (20, 3)):
        given = draw.integers(0, 256, shape)
        v = np.zeros((shape[0] + 4, shape[1] + 10))
        v[: shape[0], 5:-5] = given
        for y, x in itertools.product(range(shape[0]), range(5, shape[1] + 5)):
            new = 255.0 if v[y, x] >= 128 else 0.0
            error, v[y, x] = (v[y, x] - new) / divisor, new
            for dx, dy, share in weights:
                v[y + dy, x + dx] += error * share
        assert (analytics.diffused(given, divisor, weights) == v[: shape[0], 5:-5]).all()


def flooded(ink, eight):
    """Labels of ink in the order in which a scan meets them."""
    out, n = np.zeros(ink.shape, int), 0
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    for at in zip(*np.nonzero(ink), strict=True):
        if out[at]:
            continue
        n += 1
        todo = [at]
        while todo:
            y, x = todo.pop()
            if 0 <= y < ink.shape[0] and 0 <= x < ink.shape[1] and ink[y, x] and not out[y, x]:
                out[y, x] = n
                todo += [(y + a, x + b) for a, b in near]
    return out


@pytest.fixture(scope="module")
def inks():
    draw = np.random.default_rng(5)
    return [(draw.random((14, 30)) < share).astype(int) for share in (0.3, 0.5, 0.7)]


def test_components(spark, inks):
    for ink in inks:
        px = array(spark, ink, "ink")
        for connectivity in (4, 8):
            got = np.zeros(ink.shape, int)
            for r in analytics.label_components(px, connectivity).collect():
                got[r["y"], r["x"]] = r["label"]
            assert (got == flooded(ink, connectivity == 8)).all()


def test_clean_up(spark, inks):
    for ink in inks:
        px, black, white = array(spark, ink, "ink"), flooded(ink, True), flooded(1 - ink, False)
        size = lambda labels: np.bincount(labels.ravel())[labels]
        edge = np.ones(ink.shape, bool)
        edge[1:-1, 1:-1] = False
        holes = (white > 0) & ~np.isin(white, white[edge])
        assert (levels(pages.fill_holes(px), "ink") == np.where(holes, 1, ink)).all()
        specks = np.where((black > 0) & (size(black) <= 3), 0, ink)
        assert (levels(pages.despeckle(px, 3), "ink") == np.where((white > 0) & (size(white) <= 3), 1, specks)).all()
        large = [n for n in np.unique(black[edge & (black > 0)]) if (black == n).sum() >= 0.01 * ink.size or np.ptp(np.nonzero(black == n)[0]) + 1 >= ink.shape[0] / 2 or np.ptp(np.nonzero(black == n)[1]) + 1 >= ink.shape[1] / 2]
        assert (levels(pages.remove_borders(px), "ink") == np.where(np.isin(black, large), 0, ink)).all()


def test_lines_and_strokes(spark):
    ink = np.zeros((9, 20), int)
    ink[4, 1:18] = 1
    ink[1:8, 5] = 1
    want = ink.copy()
    want[4, 1:18] = 0
    want[4, 5] = 1  # where the stroke crosses
    assert (levels(pages.remove_lines(array(spark, ink, "ink"), 10), "ink") == want).all()
    block = np.zeros((9, 12), int)
    block[3:6, 2:10] = 1
    thin = levels(pages.thin(array(spark, block, "ink")), "ink")
    assert thin.sum() < 9 and thin[4].sum() == thin.sum() and (thin <= block).all()


def test_skew(spark):
    y, x = np.indices((60, 90))
    tilted = ((y - np.tan(np.radians(4)) * (x - 45)) % 12 < 3).astype(int)
    px = array(spark, tilted, "ink")
    found = pages.skew(px)
    assert abs(found.first()["degrees"] - 4) <= 0.3
    straight = levels(pages.deskew(px, found), "ink")[10:50, 20:70]
    assert straight.mean(1).std() > 1.2 * tilted[10:50, 20:70].mean(1).std()


def test_adaptive_equalisation(spark):
    flat = array(spark, np.full((8, 8), 90))
    assert (levels(pages.equalize_adaptive(flat, 2, 2)) == 90).all()
    two = np.tile([10, 20], (4, 4))
    assert set(np.unique(levels(pages.equalize_adaptive(array(spark, two), 1, 1)))) == {0, 255}


def test_suppression(spark):
    draw = np.random.default_rng(8)
    rows = [(img, box, *map(int, draw.integers(0, 12, 2)), *map(int, draw.integers(1, 9, 2)), float(draw.integers(0, 50))) for img in range(12) for box in range(10)]
    got = {(r["img"], r["box"]) for r in analytics.suppress(spark.createDataFrame(rows, "img long, box int, x int, y int, w int, h int, score double")).collect()}
    want = set()
    for img in range(12):
        kept = []
        for _, box, x, y, w, h, _ in sorted((r for r in rows if r[0] == img), key=lambda r: (-r[6], r[1])):
            inter = [max(0, min(x + w, c + e) - max(x, c)) * max(0, min(y + h, d + f) - max(y, d)) for c, d, e, f in kept]
            if not any(i > 0.3 * (w * h + k[2] * k[3] - i) for i, k in zip(inter, kept, strict=True)):
                kept.append((x, y, w, h))
                want.add((img, box))
    assert got == want


def test_matches(spark):
    box = "img long, box int, x int, y int, w int, h int"
    expected = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 4, 0, 10, 10), (2, 1, 0, 0, 5, 5)], box)
    # The first found box fits both; the second only the first one, so the best matching has two pairs.
    found = spark.createDataFrame([(1, 1, 2, 0, 10, 10), (1, 2, 0, 0, 9, 10), (3, 1, 0, 0, 5, 5)], box)
    counts = analytics.match_boxes(expected, found)
    assert {tuple(r) for r in counts.collect()} == {(1, 2, 0, 0), (2, 0, 0, 1), (3, 0, 1, 0)}
    assert tuple(analytics.detection_scores(counts).first()) == (2, 1, 1, 0.666666667, 0.666666667, 0.666666667)


def test_most_pairs_of_many_images():
    """Chains longer than the rounds, rings, stars and repeated pairs, all images at once."""
    draw = np.random.default_rng(12)
    graphs = [([i // 2 for i in range(199)], [(i + 1) // 2 for i in range(199)]), ([0, 0, 1, 1], [0, 1, 0, 1]), ([], []), ([3, 3, 3], [5, 5, 6])]
    graphs += [tuple(draw.integers(0, 12, (2, int(draw.integers(1, 40)))).tolist()) for _ in range(200)]
    flat = [np.concatenate([np.asarray(g[k], np.int64) for g in graphs]) for k in (0, 1)]
    got = analytics.most_pairs_each(np.repeat(np.arange(len(graphs)), [len(g[0]) for g in graphs]), *flat, len(graphs))
    assert got.tolist() == [analytics.most_pairs(*g) for g in graphs]


def test_matches_without_a_task_an_image(spark):
    """Images are matched in batches, not one Python call each; the kind of an image's key is kept."""
    box = "img string, box int, x int, y int, w int, h int"
    expected = spark.createDataFrame([(f"i{k}", b, 20 * b, 0, 10, 10) for k in range(300) for b in range(3)], box)
    found = spark.createDataFrame([(f"i{k}", 9, 20 * b, 1, 10, 10) for k in range(200) for b in (k % 3,)], box)
    counts = analytics.match_boxes(expected, found)
    assert "FlatMapGroupsInPandas" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r)[1:] for r in counts.collect()} == {(1, 0, 2), (0, 0, 3)} and counts.count() == 300


def test_scores_without_a_task_an_image(spark):
    """The named query: scores come from matches in batches, and are those of the matches image by image."""
    sf = "/root/testdata/sf0.001"
    scores = catalog.queries()["detection_scores"](spark, sf)
    assert "FlatMapGroupsInPandas" not in scores._jdf.queryExecution().optimizedPlan().toString()
    matches = catalog.queries()["detection_matches"](spark, sf).toPandas()
    names = ["true_positives", "false_positives", "false_negatives"]
    assert tuple(scores.first())[:3] == tuple(matches[names].sum())


def test_word_errors(spark):
    pairs = [("a", "the cat sat", "the bat sat on"), ("a", "", "x"), ("b", "one two", "one two"), ("c", "", "")]
    got = {tuple(r) for r in analytics.word_errors(spark.createDataFrame(pairs, "category string, ref string, hyp string")).collect()}
    assert got == {("a", 3, 3, 1.0), ("b", 2, 0, 0.0), ("c", 0, 0, None)}


def test_percentiles(spark):
    draw = np.random.default_rng(9)
    values = pd.DataFrame({"k": draw.integers(0, 3, 500), "v": np.round(draw.exponential(5, 500), 1)})
    got = {r["k"]: (r["p50"], r["p95"]) for r in analytics.value_percentiles(spark.createDataFrame(values), "k", "v", {"p50": 0.5, "p95": 0.95}, cells=16).collect()}
    for k, own in values.groupby("k")["v"]:
        ranked = sorted(own)
        assert got[k] == tuple(ranked[int(np.ceil(p * len(ranked))) - 1] for p in (0.5, 0.95))


def test_components_of_texts(spark):
    """Pages as texts give the runs that their pixels give, in pieces and with characters of several bytes."""
    draw = np.random.default_rng(21)
    letters = np.array(["a", " ", "\t", "\n", "é", "漢", "😀", "-"])
    texts = [(i, "".join(draw.choice(letters, n, p=[0.3, 0.3, 0.05, 0.05, 0.1, 0.05, 0.05, 0.1]))) for i, n in enumerate([1, 8, 9, 64, 250, 1000, 40, 333])] + [(20, ""), (21, None), (22, "   "), (23, "x" * 40)]
    pages_ = spark.createDataFrame(texts, "image_id long, text string")
    px = pages_.where("text <> ''").select("image_id", F.posexplode(F.split("text", "")).alias("i", "c")).selectExpr("image_id", "i div 8 AS y", "i % 8 AS x", "CASE WHEN c IN (' ', '\\t', '\\n') THEN 0 ELSE 1 END AS ink")
    for connectivity, piece in ((8, 1 << 22), (4, 100)):
        runs = analytics.text_components(pages_, 8, connectivity, piece)
        got = {tuple(r) for r in analytics.run_pixels(runs, "label").collect()}
        assert got == {tuple(r) for r in analytics.label_components(px.selectExpr("image_id", "CAST(y AS INT) AS y", "CAST(x AS INT) AS x", "ink"), connectivity).collect()}
        rows = runs.toPandas()
        areas = rows.groupby(["image_id", "label"])["length"].sum()
        assert (rows.set_index(["image_id", "label"])["area"] == areas.reindex(rows.set_index(["image_id", "label"]).index)).all()
        for i, own in areas.groupby("image_id"):
            assert set(rows[(rows.image_id == i) & rows.largest].label) == {own.idxmax()[1]}


@pytest.mark.parametrize("name", ["remove_small_objects", "keep_largest_component"])
def test_large_components_are_not_shuffled(spark, name):
    """The named queries label texts page by page; their pixels are not sorted or shuffled."""
    kept = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
