"""Pages in photos: planted corners are found, images without a page have none, the page alone is straight."""

import math

import numpy as np
import pytest

from rasterfold.operators import outlines
from rasterfold.plans import catalog
from rasterfold.sources import tables

SF = "/root/testdata/sf0.001"


def inside(quad, y, x):
    return all((quad[(i + 1) % 4][0] - quad[i][0]) * (y + 0.5 - quad[i][1]) - (quad[(i + 1) % 4][1] - quad[i][1]) * (x + 0.5 - quad[i][0]) >= 0 for i in range(4))


def photo(i, w, h, quad, page=210, table=50):
    return [(i, y, x, (page if quad and inside(quad, y, x) else table) + (x * 5 + y * 3) % 7) for y in range(h) for x in range(w)]


QUADS = {0: ((20, 15), (150, 22), (140, 100), (12, 92)), 1: ((9, 8), (50, 12), (47, 51), (12, 45)), 2: ((40, 30), (430, 45), (450, 380), (25, 390))}
SIZES = {0: (170, 120), 1: (60, 60), 2: (480, 410)}


@pytest.fixture(scope="module")
def photos(spark):
    rows = [r for i, q in QUADS.items() for r in photo(i, *SIZES[i], q)]
    rows += photo(10, 40, 40, None, table=90)  # nothing but grain
    rows += [(11, y, x, 128) for y in range(30) for x in range(30)]  # one colour
    rows += photo(12, 12, 40, ((2, 2), (10, 3), (9, 30), (3, 33)))  # too narrow
    rows += photo(13, 120, 120, ((50, 50), (66, 51), (65, 66), (51, 65)))  # too small a thing
    return spark.createDataFrame(rows, "image_id long, y int, x int, l int").cache()


@pytest.fixture(scope="module")
def corners(photos):
    return outlines.page_corners(photos).cache()


def test_planted_corners(corners):
    got = {r["image_id"]: r["quad"] for r in corners.collect()}
    assert set(got) == {0, 1, 2, 10, 11, 12, 13}
    for i, quad in QUADS.items():
        assert [max(abs(p["x"] - x), abs(p["y"] - y)) < 1 for p, (x, y) in zip(got[i], quad, strict=True)] == [True] * 4, (i, got[i])
    assert got[11] is None and got[12] is None and got[13] is None


def test_page_alone_is_the_page(photos, corners):
    page = {}
    for r in outlines.page_alone(photos, corners).where("image_id in (0, 1)").collect():
        page.setdefault(r["image_id"], {})[r["y"], r["x"]] = r["l"]
    for i in (0, 1):
        (x0, y0), (x1, y1), (x2, y2), (x3, y3) = QUADS[i]
        w = max(math.dist((x0, y0), (x1, y1)), math.dist((x3, y3), (x2, y2)))
        h = max(math.dist((x0, y0), (x3, y3)), math.dist((x1, y1), (x2, y2)))
        tall, wide = (max(k) + 1 for k in zip(*page[i], strict=True))
        assert abs(wide - w) <= 1.5 and abs(tall - h) <= 1.5 and len(page[i]) == tall * wide
        middle = [v for (y, x), v in page[i].items() if 2 <= y < tall - 2 and 2 <= x < wide - 2]
        assert min(middle) >= 200


def test_hull_and_corners():
    draw = np.random.default_rng(2)
    points = draw.integers(0, 30, (200, 2)).astype(float)
    found = outlines.hull(points)
    for i in range(len(found)):
        a, b = found[i], found[(i + 1) % len(found)]
        cross = (b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0])
        assert (cross >= -1e-9).all()
    square = np.array([(0, 0), (10, 1), (11, 9), (5, 9.5), (1, 10)], float)
    assert outlines.four_corners(square).tolist() == [[0, 0], [10, 1], [11, 9], [1, 10]]
    assert outlines.four_corners(square[:3]) is None


def test_photos_of_the_tables(spark):
    got = {}
    for r in catalog.queries()["page_corners"](spark, SF).collect():
        got.setdefault(r["image_id"], []).append((r["corner"], r["x"], r["y"]))
    assert len(got) == spark.read.parquet(f"{SF}/supplier.parquet").count()
    near = 0
    for k, found in got.items():
        want = [tuple(eval(e, {"k": k}) for e in c) for c in tables.PHOTO_CORNERS]
        near += all(abs(x - u) < 1 and abs(y - v) < 1 for (_, x, y), (u, v) in zip(sorted(found), want, strict=True)) if found[0][0] is not None else 0
    assert near == len(got)


@pytest.mark.parametrize("name", ["page_corners", "page_alone"])
def test_pixels_are_not_broadcast(spark, name, tmp_path):
    """Photos of a small table are many pixels; a table of them that goes to the driver is over this size and would be an error."""
    spark.read.parquet(f"{SF}/supplier.parquet").selectExpr("* except (s_suppkey)", "explode(sequence(s_suppkey, s_suppkey + 190, 10)) AS s_suppkey").dropDuplicates(["s_suppkey"]).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")
    try:
        rows = catalog.queries()[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len({r["image_id"] for r in rows}) == 200


def test_page_alone_of_channels_over_bands(spark):
    """A page higher than a band, turned a little, with two channels: each pixel is the level between four of the image."""
    h, w = 200, 90
    quad = ((9.0, 4.0), (80.0, 12.0), (77.0, 190.0), (5.0, 181.0))
    draw = np.random.default_rng(6)
    planes = draw.integers(0, 256, (2, h, w))
    px = spark.createDataFrame([(7, y, x, int(planes[0, y, x]), int(planes[1, y, x])) for y in range(h) for x in range(w)], "image_id long, y int, x int, l int, r int")
    corners = spark.createDataFrame([(7, [{"x": x, "y": y} for x, y in quad])], "image_id long, quad array<struct<x: double, y: double>>")
    got = {(r["y"], r["x"]): (r["l"], r["r"]) for r in outlines.page_alone(px, corners, ("l", "r")).collect()}
    wide = math.floor(max(math.dist(quad[0], quad[1]), math.dist(quad[3], quad[2])) + 0.5)
    tall = math.floor(max(math.dist(quad[0], quad[3]), math.dist(quad[1], quad[2])) + 0.5)
    assert set(got) == {(y, x) for y in range(tall) for x in range(wide)}
    unit = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
    rows = [r for (u, v), (x, y) in zip(unit, quad, strict=True) for r in ([u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y])]
    m = np.append(np.linalg.solve(np.array(rows), np.array(quad).ravel()), 1).reshape(3, 3)
    for (ty, tx), found in got.items():
        sx, sy, below = m @ ((tx + 0.5) / wide, (ty + 0.5) / tall, 1)
        sx, sy = sx / below - 0.5, sy / below - 0.5
        fx, fy = sx - math.floor(sx), sy - math.floor(sy)
        at = lambda p, j, i: p[min(h - 1, max(0, math.floor(sy) + j)), min(w - 1, max(0, math.floor(sx) + i))]  # noqa: B023, E731
        for v, p in zip(found, planes, strict=True):
            want = (1 - fy) * ((1 - fx) * at(p, 0, 0) + fx * at(p, 0, 1)) + fy * ((1 - fx) * at(p, 1, 0) + fx * at(p, 1, 1))
            assert abs(v - want) <= 0.5 + 1e-4
