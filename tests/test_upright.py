"""Which way up pages are: pages like text, turned all four ways, are told and turned back."""

import random

import pytest

from rasterfold.operators import geometry, upright


def text_page(seed, width=200, height=420):
    """Ink like text: cores of lines, more strokes above them than below, even left and ragged right ends."""
    draw = random.Random(seed)
    ink = set()
    for top in range(14, height - 14, 13):
        right = draw.randint(width // 2, width - 14)
        x = 12
        while x < right:
            if draw.random() < 0.8:
                ink |= {(top + dy, x + dx) for dy in range(5) for dx in range(2)}
                if draw.random() < 0.4:
                    ink |= {(top - dy, x) for dy in range(1, 4)}
                elif draw.random() < 0.15:
                    ink |= {(top + 4 + dy, x) for dy in range(1, 3)}
            x += draw.choice((3, 4, 5, 7))
    return [(y, x, int((y, x) in ink)) for y in range(height) for x in range(width)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, *p) for i in range(2) for p in text_page(i)]
    rows += [(7, y, x, 0) for y in range(30) for x in range(30)] + [(8, y, x, 1) for y in range(30) for x in range(30)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, ink int").cache()


@pytest.mark.parametrize("degrees", [0, 90, 180, 270])
def test_turned_pages_are_told(pages, degrees):
    turned = geometry.turn(pages, degrees)
    got = {r["image_id"]: (r["degrees"], r["confidence"]) for r in upright.orientation(turned).collect()}
    assert got[0][0] == got[1][0] == (360 - degrees) % 360 and min(got[0][1], got[1][1]) > 0.3
    assert got[7] == (0, 0.0) and got[8] == (0, 0.0)
    back = upright.upright(turned, upright.orientation(turned)).where("image_id < 2 and ink = 1").select("image_id", "y", "x").collect()
    assert {tuple(r) for r in back} == {tuple(r) for r in pages.where("image_id < 2 and ink = 1").select("image_id", "y", "x").collect()}


def test_rules_are_left_out(spark):
    rows = [(0, y, x, int(y == 5 or x == 9 or (y, x) == (20, 20))) for y in range(60) for x in range(80)]
    got = upright.without_rules(spark.createDataFrame(rows, "image_id long, y int, x int, ink int")).where("ink = 1").collect()
    assert [(r["y"], r["x"]) for r in got] == [(20, 20)]
