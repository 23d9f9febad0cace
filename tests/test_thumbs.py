"""Packed placeholders against a plain version, byte by byte, and back."""

import math

import numpy as np
import pytest

from rasterfold.operators import thumbs


def plain_encode(rgba):
    h, w, _ = rgba.shape
    a = rgba[..., 3] / 255
    mean = [(a * rgba[..., k] / 255).sum() / a.sum() if a.sum() else 0.0 for k in range(3)]
    clear = rgba[..., 3].sum() < 255 * w * h
    limit = 5 if clear else 7
    lx, ly = (max(1, math.floor(limit * n / max(w, h) + 0.5)) for n in (w, h))
    r, g, b = (mean[k] * (1 - a) + a * rgba[..., k] / 255 for k in range(3))
    whole = lambda v: math.floor(round(v, 9) + 0.5)

    def channel(plane, nx, ny):
        out = []
        for cy in range(ny):
            for cx in range(nx):
                if cx * ny < nx * (ny - cy):
                    basis = np.cos(math.pi / h * cy * (np.arange(h) + 0.5))[:, None] * np.cos(math.pi / w * cx * (np.arange(w) + 0.5))
                    out.append(round(float((plane * basis).mean()), 9))
        dc, ac = out[0], out[1:]
        scale = max(map(abs, ac))
        return dc, [0.5 + 0.5 / scale * f for f in ac] if scale else ac, scale

    (l, al, sl), (p, ap, sp), (q, aq, sq) = channel((r + g + b) / 3, max(3, lx), max(3, ly)), channel((r + g) / 2 - b, 3, 3), channel(r - g, 3, 3)
    first = whole(63 * l) | whole(31.5 + 31.5 * p) << 6 | whole(31.5 + 31.5 * q) << 12 | whole(31 * sl) << 18 | int(clear) << 23
    second = (ly if w > h else lx) | whole(63 * sp) << 3 | whole(63 * sq) << 9 | int(w > h) << 15
    out = [first & 255, first >> 8 & 255, first >> 16, second & 255, second >> 8]
    acs = [al, ap, aq]
    if clear:
        o, ao, so = channel(a, 5, 5)
        out.append(whole(15 * o) | whole(15 * so) << 4)
        acs.append(ao)
    halves = [whole(15 * f) for ac in acs for f in ac]
    halves += [0] * (len(halves) % 2)
    return bytes(out + [halves[i] | halves[i + 1] << 4 for i in range(0, len(halves), 2)]).hex()


def plain_decode(text, most):
    data = bytes.fromhex(text)
    first, second = data[0] | data[1] << 8 | data[2] << 16, data[3] | data[4] << 8
    clear, wide = first >> 23, second >> 15
    limit = 5 if clear else 7
    sx, sy = (limit, second & 7) if wide else (second & 7, limit)
    halves = [v for x in data[6 if clear else 5 :] for v in (x & 15, x >> 4)]
    ratio = sx / sy
    w, h = max(1, math.floor((most if ratio > 1 else most * ratio) + 0.5)), max(1, math.floor((most / ratio if ratio > 1 else most) + 0.5))
    at = 0

    def channel(dc, nx, ny, scale):
        nonlocal at
        plane = np.full((h, w), dc, float)
        for cy in range(ny):
            for cx in range(nx):
                if (cx or cy) and cx * ny < nx * (ny - cy):
                    f = (halves[at] / 7.5 - 1) * scale
                    at += 1
                    plane += 2 * f * np.cos(math.pi / h * cy * (np.arange(h) + 0.5))[:, None] * np.cos(math.pi / w * cx * (np.arange(w) + 0.5))
        return plane

    l = channel((first & 63) / 63, max(3, sx), max(3, sy), (first >> 18 & 31) / 31)
    p = channel((first >> 6 & 63) / 31.5 - 1, 3, 3, (second >> 3 & 63) / 63 * 1.25)
    q = channel((first >> 12 & 63) / 31.5 - 1, 3, 3, (second >> 9 & 63) / 63 * 1.25)
    a = channel((data[5] & 15) / 15, 5, 5, (data[5] >> 4) / 15) if clear else np.ones((h, w))
    b = l - 2 / 3 * p
    r = (3 * l - b + q) / 2
    return np.floor(np.round(np.clip(np.stack([r, r - q, b, a], -1), 0, 1) * 255, 6) + 0.5).astype(int)


@pytest.fixture(scope="module")
def pictures(spark):
    draw = np.random.default_rng(3)
    found = []
    for h, w, clear in ((16, 64, True), (20, 20, False), (40, 13, False), (9, 14, True), (1, 5, False), (6, 6, True)):
        y, x = np.mgrid[0:h, 0:w]
        rgba = np.stack([(x * 255 // max(1, w - 1) + draw.integers(0, 30)) % 256, y * 200 // max(1, h), draw.integers(0, 256, (h, w)), np.full((h, w), 255)], -1)
        if clear:
            rgba[..., 3] = draw.integers(0, 256, (h, w))
        found.append(rgba)
    found[5][..., 3] = 0
    rows = [(i, y, x, *map(int, p[y, x])) for i, p in enumerate(found) for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int"), found


def test_bytes(spark, pictures):
    px, found = pictures
    got = {r["image_id"]: r["hash"] for r in thumbs.thumb_hash(px).collect()}
    assert got == {i: plain_encode(p) for i, p in enumerate(found)}
    texts = spark.createDataFrame(list(got.items()), "image_id long, hash string")
    back = {}
    for r in thumbs.from_thumb_hash(texts, 16).collect():
        back.setdefault(r["image_id"], {})[r["y"], r["x"]] = (r["r"], r["g"], r["b"], r["a"])
    for i, text in got.items():
        want = plain_decode(text, 16)
        assert back[i] == {(y, x): tuple(want[y, x]) for y in range(want.shape[0]) for x in range(want.shape[1])}
    means = {r["image_id"]: r for r in thumbs.mean_colour(texts).collect()}
    assert abs(means[1]["r"] - found[1][..., 0].mean()) < 8 and abs(means[1]["g"] - found[1][..., 1].mean()) < 8 and means[1]["aspect"] == 1 and means[0]["aspect"] > 2 and means[5]["a"] == 0


def test_texts_that_are_too_short(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "12345678")], "image_id long, hash string")
    assert thumbs.mean_colour(texts).count() == thumbs.from_thumb_hash(texts).count() == 0
