"""Geometry and matching over images of any size and chains of any length."""

import itertools
import random

import pytest

from rasterfold.operators import analytics, geometry


@pytest.fixture(scope="module")
def odd_sizes(spark):
    """Images of 5 x 3, 1 x 1 and 4 x 7 pixels whose level tells their place."""
    rows = [(i, y, x, 20 * y + x) for i, (w, h) in enumerate(((5, 3), (1, 1), (4, 7))) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, l int"), ((5, 3), (1, 1), (4, 7))


def places(df):
    return {(r["image_id"], r["y"], r["x"]): r["l"] for r in df.collect()}


def test_nearest_of_each_size(odd_sizes):
    px, sizes = odd_sizes
    for tw, th in ((8, 4), (2, 9), (1, 1)):
        got = places(geometry.resize_nearest(px, tw, th))
        assert got == {(i, y, x): 20 * (y * h // th) + x * w // tw for i, (w, h) in enumerate(sizes) for y in range(th) for x in range(tw)}


def test_flips_and_turns_stay_on_the_canvas(odd_sizes):
    px, sizes = odd_sizes
    down, turned = places(geometry.flip(px, "vertical")), places(geometry.turn(px, 90))
    for i, (w, h) in enumerate(sizes):
        for y, x in itertools.product(range(h), range(w)):
            assert down[i, h - 1 - y, x] == 20 * y + x and turned[i, x, h - 1 - y] == 20 * y + x


def brute(pairs):
    best = 0
    for n in range(len(pairs), 0, -1):
        for some in itertools.combinations(pairs, n):
            if len({a for a, _ in some}) == len({b for _, b in some}) == n:
                return n
    return best


def test_most_pairs_against_all_choices():
    draw = random.Random(5)
    for _ in range(60):
        pairs = sorted({(draw.randint(0, 4), draw.randint(0, 4)) for _ in range(draw.randint(1, 9))})
        assert analytics.most_pairs([a for a, _ in pairs], [b for _, b in pairs]) == brute(pairs)


def test_long_chains():
    n = 3000
    pairs = [(i, i) for i in range(1, n)] + [(i, i - 1) for i in range(1, n + 1)]
    assert analytics.most_pairs(*zip(*pairs, strict=True)) == n
    assert analytics.most_pairs([], []) == 0


def test_chained_boxes(spark):
    boxes = spark.createDataFrame([(1, i, 10 * i, 0, 14, 10) for i in range(2000)], "img long, box long, x int, y int, w int, h int")
    got = analytics.match_boxes(boxes, boxes.selectExpr("img", "box", "x + 5 AS x", "y", "w", "h"), 0.3).collect()
    assert [tuple(r) for r in got] == [(1, 2000, 0, 0)]
