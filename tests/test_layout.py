"""Lines and words against a plain scan of the page."""

import random

from rasterfold.operators import layout


def plain(ink, height, width):
    rows = [any((y, x) in ink for x in range(width)) for y in range(height)] + [False]
    runs, start = [], None
    for y, inked in enumerate(rows):
        if inked and start is None:
            start = y
        elif not inked and start is not None:
            runs.append((start, y - 1))
            start = None
    if not runs:
        return set()
    middle = sorted(b - a + 1 for a, b in runs)[len(runs) // 2]
    lines = [runs[0]]
    for a, b in runs[1:]:
        c, d = lines[-1]
        if ((b - a + 1) * 2 < middle or (d - c + 1) * 2 < middle) and a - d - 1 <= max(1, middle // 3):
            lines[-1] = (c, b)
        else:
            lines.append((a, b))
    out, n = set(), 0
    for a, b in lines:
        if b - a + 1 < 2:
            continue
        n += 1
        columns = sorted({x for y, x in ink if a <= y <= b})
        gap = max(2, round((b - a + 1) * 0.4))
        parts = [[columns[0]]]
        for x in columns[1:]:
            if x - parts[-1][-1] - 1 >= gap:
                parts.append([])
            parts[-1].append(x)
        for k, part in enumerate(parts):
            ys = [y for y, x in ink if a <= y <= b and part[0] <= x <= part[-1]]
            out.add((n, k + 1, part[0], min(ys), part[-1] + 1, max(ys) + 1))
    return out


def test_words_against_a_plain_scan(spark):
    draw = random.Random(12)
    pages, rows = {}, []
    for i in range(6):
        ink, y = set(), 3
        while y < 70:
            tall, x = draw.choice((1, 1, 6, 7, 8)), draw.randint(0, 9)
            while x < 78:
                if draw.random() < 0.7:
                    ink |= {(y + dy, x + dx) for dy in range(tall) for dx in range(draw.randint(1, 3)) if draw.random() < 0.9}
                x += draw.choice((2, 3, 4, 9))
            y += tall + draw.choice((1, 1, 2, 4))
        pages[i] = {p for p in ink if p[0] < 80 and p[1] < 80}
        rows += [(i, y, x, int((y, x) in pages[i])) for y in range(80) for x in range(80)]
    rows += [(9, y, x, 0) for y in range(4) for x in range(4)]
    got = {}
    for r in layout.words(spark.createDataFrame(rows, "image_id long, y int, x int, ink int")).collect():
        got.setdefault(r["image_id"], set()).add(tuple(r)[1:])
    assert got == {i: plain(p, 80, 80) for i, p in pages.items()} and sum(map(len, got.values())) > 100
