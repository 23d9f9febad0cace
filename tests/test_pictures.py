"""Palettes, pyramids and grids against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest

from rasterfold.operators import bands, fidelity, grids, palettes


def plain_boxes(pixels, budget):
    """Boxes of cells cut by trying all places, with sums over the pixels themselves."""

    def stats(box):
        inside = [p for p in pixels if all(lo <= v // 8 < hi for v, (lo, hi) in zip(p, box, strict=True))]
        return len(inside), [sum(p[k] for p in inside) for k in range(3)], sum(v * v for p in inside for v in p)

    def variance(box):
        n, sums, squares = stats(box)
        size = math.prod(hi - lo for lo, hi in box)
        return squares - sum(v * v for v in sums) / n if n and size > 1 else 0.0

    boxes = [((0, 32),) * 3]
    spread = [variance(boxes[0])]
    while len(boxes) < budget and max(spread) > 0:
        k = spread.index(max(spread))
        best = None
        for axis in range(3):
            lo, hi = boxes[k][axis]
            for at in range(lo + 1, hi):
                one, two = (tuple(r if j == axis else b for j, b in enumerate(boxes[k])) for r in ((lo, at), (at, hi)))
                (n1, s1, _), (n2, s2, _) = stats(one), stats(two)
                if n1 and n2:
                    gain = sum(v * v for v in s1) / n1 + sum(v * v for v in s2) / n2
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, one, two)
        if best is None:
            spread[k] = 0.0
            continue
        boxes[k], spread[k] = best[1], variance(best[1])
        boxes.append(best[2])
        spread.append(variance(best[2]))
    out = []
    for box in boxes:
        n, sums, _ = stats(box)
        if n:
            out.append(tuple((v + n // 2) // n for v in sums))
    return out


@pytest.fixture(scope="module")
def coloured(spark):
    """Three images: many colours, one colour, and only transparent pixels with one opaque."""
    draw = random.Random(8)
    rows = [(0, y, x, *(draw.choice((10, 60, 61, 130, 200, 255)) + draw.randint(-4, 0) for _ in range(3)), draw.choice((255, 255, 255, 10))) for y in range(9) for x in range(11)]
    rows += [(1, y, x, 7, 77, 177, 255) for y in range(2) for x in range(3)]
    rows += [(2, 0, x, x, x, x, 255 if x == 2 else 0) for x in range(4)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int"), rows


@pytest.mark.parametrize("colors", [2, 5, 12])
def test_wu_against_all_cuts(coloured, colors):
    px, rows = coloured
    got = {}
    for r in palettes.wu_palette(px, colors).orderBy("image_id", "entry").collect():
        got.setdefault(r["image_id"], []).append((r["r"], r["g"], r["b"]))
    for i in range(3):
        mine = [r for r in rows if r[0] == i]
        budget = colors - any(r[6] < palettes.CUTOFF for r in mine)
        assert got[i] == plain_boxes([r[3:6] for r in mine if r[6] >= palettes.CUTOFF], budget)


def plain_octree(pixels, budget):
    leaves = {}
    for p in pixels:
        code = tuple(((p[0] >> k & 1) << 2 | (p[1] >> k & 1) << 1 | p[2] >> k & 1) for k in range(7, -1, -1))
        n, *s = leaves.get(code, (0, 0, 0, 0))
        leaves[code] = (n + 1, *(a + b for a, b in zip(s, p, strict=True)))
    while len(leaves) > budget:
        depth = max(map(len, leaves)) - 1
        if depth == 0:
            break
        nodes = {}
        for code, v in leaves.items():
            if len(code) == depth + 1:
                nodes[code[:-1]] = nodes.get(code[:-1], 0) + v[0]
        least = min(nodes, key=lambda c: (nodes[c], c))
        gone = [c for c in leaves if c[:-1] == least and len(c) == depth + 1]
        leaves[least] = tuple(map(sum, zip(*(leaves.pop(c) for c in gone), strict=True)))
    return [tuple((v + n // 2) // n for v in s) for _, (n, *s) in sorted(leaves.items())]


@pytest.mark.parametrize("colors", [2, 7, 30, 256])
def test_octree_against_single_merges(coloured, colors):
    px, rows = coloured
    got = {}
    for r in palettes.octree_palette(px, colors).orderBy("image_id", "entry").collect():
        got.setdefault(r["image_id"], []).append((r["r"], r["g"], r["b"]))
    for i in range(3):
        mine = [r for r in rows if r[0] == i]
        budget = colors - any(r[6] < palettes.CUTOFF for r in mine)
        assert got[i] == plain_octree([r[3:6] for r in mine if r[6] >= palettes.CUTOFF], budget)


def test_matching_takes_the_nearest_and_keeps_transparency(coloured):
    px, rows = coloured
    palette = palettes.wu_palette(px, 6)
    entries = {}
    for r in palette.orderBy("image_id", "entry").collect():
        entries.setdefault(r["image_id"], []).append((r["r"], r["g"], r["b"]))
    got = {(r["image_id"], r["y"], r["x"]): (r["r"], r["g"], r["b"], r["a"]) for r in palettes.matched(px, palette).collect()}
    assert len(got) == len(rows)
    for i, y, x, *rgb, a in rows:
        want = (0, 0, 0, 0) if a < palettes.CUTOFF else (*min(entries[i], key=lambda p: sum((u - v) ** 2 for u, v in zip(p, rgb, strict=True))), 255)
        assert got[i, y, x] == want


def images(spark, sizes, seed=1):
    draw = np.random.default_rng(seed)
    planes = [draw.integers(0, 256, (2, h, w)) for h, w in sizes]
    rows = [(i, y, x, int(p[0, y, x]), int(p[1, y, x])) for i, p in enumerate(planes) for y in range(p.shape[1]) for x in range(p.shape[2])]
    return spark.createDataFrame(rows, "image_id long, y int, x int, l int, l2 int"), planes


def plain_ssim(x, y):
    out = []
    g = np.outer(fidelity.GAUSS, fidelity.GAUSS)
    for v in range(x.shape[0] - 10):
        for u in range(x.shape[1] - 10):
            a, b = x[v : v + 11, u : u + 11], y[v : v + 11, u : u + 11]
            ma, mb = (g * a).sum(), (g * b).sum()
            va, vb, ab = (g * a * a).sum() - ma * ma, (g * b * b).sum() - mb * mb, (g * a * b).sum() - ma * mb
            s = (2 * ab + fidelity.C2) / (va + vb + fidelity.C2)
            out.append((s * (2 * ma * mb + fidelity.C1) / (ma * ma + mb * mb + fidelity.C1), s))
    return np.mean(out, 0) if out else None


@pytest.mark.parametrize("band", [3, 8, 64])
def test_similarity_by_bands(spark, band):
    px, planes = images(spark, ((23, 14), (11, 11), (10, 40), (5, 3)))
    got = {r["image_id"]: (r["ssim"], r["structure"]) for r in fidelity.similarity(px, band=band).collect()}
    assert set(got) == {0, 1}
    for i in got:
        assert np.allclose(got[i], plain_ssim(*planes[i].astype(float)))


def test_scales(spark):
    px, planes = images(spark, ((161, 165), (40, 160)), 4)
    got = {r["image_id"]: r["ms_ssim"] for r in fidelity.multi_scale(px).collect()}
    x, y = planes[0].astype(float)
    want = 1.0
    for k, w in enumerate(fidelity.WEIGHTS):
        ssim, structure = plain_ssim(x, y)
        want *= max(0.0, ssim if k == 4 else structure) ** w
        x, y = (np.pad(p, ((0, p.shape[0] % 2), (0, p.shape[1] % 2)), "edge").reshape(-(-p.shape[0] // 2), 2, -(-p.shape[1] // 2), 2).mean((1, 3)) for p in (x, y))
    assert got[0] == pytest.approx(want) and got[1] is None
    same = fidelity.multi_scale(px.selectExpr("image_id", "y", "x", "l", "l AS l2")).where("image_id = 0").first()["ms_ssim"]
    assert same == pytest.approx(1)


def test_halves(spark):
    px, planes = images(spark, ((5, 3),))
    got = {(r["y"], r["x"]): r["l"] for r in bands.halved(px, "l").collect()}
    p = planes[0][0]
    assert got == {(y, x): p[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() for y in range(3) for x in range(2)}


def test_grid_against_dense_arrays(spark):
    px, planes = images(spark, ((13, 17), (3, 2)), 6)
    spatial, levels = 2.0, 50.0
    got = {(r["image_id"], r["y"], r["x"]): (r["l"], r["l2"]) for r in grids.bilateral_grid(px, spatial, levels, ("l", "l2")).collect()}
    side, depth = spatial * grids.CELL, levels * grids.CELL
    for i, pair in enumerate(planes):
        for c, plane in enumerate(pair.astype(float)):
            h, w = plane.shape
            place = lambda y, x: ((plane[y, x] - plane.min()) / depth + 2, y / side + 2, x / side + 2)  # noqa: B023, E731
            table = np.zeros((2, int(255 / depth) + 8, int(h / side) + 8, int(w / side) + 8))

            def corners(g):
                low = [int(v) for v in g]
                for d in itertools.product((0, 1), repeat=3):
                    yield tuple(a + b for a, b in zip(low, d, strict=True)), math.prod(v - a if b else 1 - (v - a) for v, a, b in zip(g, low, d, strict=True))

            for y, x in itertools.product(range(h), range(w)):
                for at, k in corners(place(y, x)):
                    table[(0, *at)] += k * plane[y, x]
                    table[(1, *at)] += k
            for axis in (1, 2, 3):
                table = np.apply_along_axis(lambda v: np.convolve(v, grids.KERNEL, "same"), axis, table)
            for y, x in itertools.product(range(h), range(w)):
                s, n = (sum(k * table[(t, *at)] for at, k in corners(place(y, x))) for t in (0, 1))
                assert got[i, y, x][c] == min(255, math.floor(round(s / n, 5) + 0.5))


def test_similarity_of_uneven_lines(spark):
    """The last line ends early, one line has a gap and one isn't there: only windows that are whole count."""
    px, planes = images(spark, ((24, 30), (11, 12)), 8)
    gone = "image_id = 0 and ((y = 23 and x >= 13) or (y = 4 and x = 20) or (y = 12 and x < 3)) or image_id = 1 and y = 10 and x = 11"
    there = np.ones((24, 30), bool)
    there[23, 13:] = there[4, 20] = there[12, :3] = False
    x, y = planes[0].astype(float)
    own = [plain_ssim(x[v : v + 11, u : u + 11], y[v : v + 11, u : u + 11]) for v in range(14) for u in range(20) if there[v : v + 11, u : u + 11].all()]
    for band in (5, 64):
        got = {r["image_id"]: r for r in fidelity.similarity(px.where(f"not ({gone})"), band=band).collect()}
        assert got[0]["windows"] == len(own) and np.allclose((got[0]["ssim"], got[0]["structure"]), np.mean(own, 0))
        assert got[1]["windows"] == 1
    assert [r["windows"] for r in fidelity.similarity(px.where("y <> 11 and y <> 22 and image_id = 0")).collect()] == [20]


def test_grid_by_tiles(spark, monkeypatch):
    """Tiles and their margins give what whole images give, whatever the sizes; pixels meet no table of cells and are shuffled once."""
    px, _ = images(spark, ((150, 20), (3, 300), (70, 270), (1, 1)), 14)
    got = grids.bilateral_grid(px, 2.0, 50.0, ("l", "l2"))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {tuple(r) for r in got.collect()}
    monkeypatch.setattr(grids, "TILE", (1000, 1000))
    assert found == {tuple(r) for r in grids.bilateral_grid(px, 2.0, 50.0, ("l", "l2")).collect()} and len(found) == 3000 + 900 + 18900 + 1


def test_grid_of_many_levels(spark):
    """Layers that no pixel is near to are left out, which changes nothing; a pixel without a level is 0."""
    rows = [(0, y, x, int(l)) for y in range(6) for x, l in enumerate((0, 1, 2, 250, 251, 90))] + [(0, 6, 0, None)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, l int")
    got = {(r["y"], r["x"]): r["l"] for r in grids.bilateral_grid(px, 2.0, 0.4).collect()}
    assert len(got) == 37 and got[6, 0] == 0
    assert [got[3, x] for x in (3, 4, 5)] == [250, 251, 90]
