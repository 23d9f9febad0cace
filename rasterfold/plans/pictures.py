"""Palettes of an image's own colours, pyramids, grids and page outlines, with SQL where SQL can say it."""

from __future__ import annotations

from rasterfold.functions import color, kernels
from rasterfold.functions.numbers import byte, clamp, from_unit, luma, num
from rasterfold.operators import crops, fidelity, gather, geometry, grids, layout, lines, metadata, outlines, palettes, placeholders, thumbs, upright, windows
from rasterfold.plans.imaging import _FILTERS, AT, SIZE_SQL, Query, _gather
from rasterfold.sources import tables
from rasterfold.sources.tables import GRAY_SQL, RGBA_SQL, SHEET_SQL

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# Palettes of 16 colours. The cuts of boxes are beyond SQL; tests hold them against a plain loop.
_COLORS = 16
add("quantize_wu", lambda s, d: palettes.matched(tables.rgba(s, d), palettes.wu_palette(tables.rgba(s, d), _COLORS)))
add("palette_wu", lambda s, d: palettes.wu_palette(tables.rgba(s, d), _COLORS))

_BITS = " + ".join(f"((r // {1 << 7 - k} % 2) * 4 + (g // {1 << 7 - k} % 2) * 2 + b // {1 << 7 - k} % 2) * {8 ** (7 - k)}" for k in range(8))
_OCTREE = f"""{RGBA_SQL},
col AS (SELECT image_id, {_BITS} AS code, count(*) AS n, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb FROM px WHERE a >= {palettes.CUTOFF} GROUP BY 1, 2),
node AS (SELECT image_id, u.d AS depth, code // CAST(power(8, 8 - u.d) AS BIGINT) AS code, sum(n) AS n, sum(sr) AS sr, sum(sg) AS sg, sum(sb) AS sb FROM col, generate_series(1, 8) u(d) GROUP BY 1, 2, 3),
num AS (SELECT image_id, depth, count(*) AS n FROM node GROUP BY 1, 2),
bud AS (SELECT image_id, {_COLORS} - max(CASE WHEN a < {palettes.CUTOFF} THEN 1 ELSE 0 END) AS budget FROM px GROUP BY 1),
lev AS (SELECT image_id, least(8, max(depth) FILTER (depth = 1 OR n <= budget) + 1) AS depth FROM num JOIN bud USING (image_id) GROUP BY 1),
lea AS (SELECT node.*, node.code // 8 AS up, num.n - budget AS excess FROM node JOIN lev USING (image_id, depth) JOIN num USING (image_id, depth) JOIN bud USING (image_id)),
par AS (SELECT image_id, up, depth, excess, sum(n) AS n, sum(sr) AS sr, sum(sg) AS sg, sum(sb) AS sb, count(*) AS kids FROM lea GROUP BY 1, 2, 3, 4),
mer AS (SELECT *, coalesce(sum(kids - 1) OVER (PARTITION BY image_id ORDER BY n, up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < excess AS merged FROM par),
fin AS (SELECT image_id, up AS code, depth - 1 AS depth, n, sr, sg, sb FROM mer WHERE merged
  UNION ALL SELECT l.image_id, l.code, l.depth, l.n, l.sr, l.sg, l.sb FROM lea l JOIN mer m ON m.image_id = l.image_id AND m.up = l.up AND NOT m.merged),
pal AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY code * CAST(power(8, 8 - depth) AS BIGINT)) - 1 AS entry, CAST((sr + n // 2) // n AS INT) AS pr, CAST((sg + n // 2) // n AS INT) AS pg, CAST((sb + n // 2) // n AS INT) AS pb FROM fin)"""
add("palette_octree", lambda s, d: palettes.octree_palette(tables.rgba(s, d), _COLORS), f"WITH {_OCTREE} SELECT image_id, entry, pr AS r, pg AS g, pb AS b FROM pal")
add(
    "quantize_octree",
    lambda s, d: palettes.matched(tables.rgba(s, d), palettes.octree_palette(tables.rgba(s, d), _COLORS)),
    f"WITH {_OCTREE}, best AS (SELECT image_id, y, x, a, pr, pg, pb FROM px JOIN pal USING (image_id) QUALIFY row_number() OVER (PARTITION BY image_id, y, x ORDER BY (pr - r) * (pr - r) + (pg - g) * (pg - g) + (pb - b) * (pb - b), entry) = 1) SELECT {AT}, " + ", ".join(f"CASE WHEN a < {palettes.CUTOFF} THEN 0 ELSE p{c} END AS {c}" for c in "rgb") + f", CASE WHEN a < {palettes.CUTOFF} THEN 0 ELSE 255 END AS a FROM best",
)

# Similarity on five scales, each halved from the one before.
_SIGNALS = {"ma": "{0}", "mb": "{1}", "qa": "{0} * {0}", "qb": "{1} * {1}", "ab": "{0} * {1}"}
_STRUCTURE = f"(2 * (ab - ma * mb) + {num(fidelity.C2)}) / (qa - ma * ma + qb - mb * mb + {num(fidelity.C2)})"
_LIKENESS = f"(2 * ma * mb + {num(fidelity.C1)}) / (ma * ma + mb * mb + {num(fidelity.C1)})"
_KERNEL = f"kern AS (SELECT * FROM (VALUES {', '.join(f'({i}, {num(w)})' for i, w in enumerate(fidelity.GAUSS))}) v(i, w))"


def _scale_sql(k: int) -> str:
    source = f"s{k} AS (SELECT image_id, y, x, CAST(l AS DOUBLE) AS l, CAST(l2 AS DOUBLE) AS l2 FROM sheet_pair)" if k == 0 else f"s{k} AS (SELECT image_id, y // 2 AS y, x // 2 AS x, avg(l) AS l, avg(l2) AS l2 FROM s{k - 1} GROUP BY 1, 2, 3)"
    across = ", ".join(f"sum(w * {e.format('q.l', 'q.l2')}) AS {n}" for n, e in _SIGNALS.items())
    down = ", ".join(f"sum(w * q.{n}) AS {n}" for n in _SIGNALS)
    return f"""{source},
a{k} AS (SELECT p.image_id, p.y, p.x, {across} FROM s{k} p, kern, s{k} q WHERE q.image_id = p.image_id AND q.y = p.y AND q.x = p.x + kern.i GROUP BY 1, 2, 3 HAVING count(*) = 11),
d{k} AS (SELECT p.image_id, p.y, p.x, {down} FROM a{k} p, kern, a{k} q WHERE q.image_id = p.image_id AND q.x = p.x AND q.y = p.y + kern.i GROUP BY 1, 2, 3 HAVING count(*) = 11),
m{k} AS (SELECT image_id, greatest(0e0, avg({_STRUCTURE}{f' * ({_LIKENESS})' if k == 4 else ''})) AS t{k} FROM d{k} GROUP BY 1)"""


_PRODUCT = " * ".join(f"power(t{k}, {num(w)})" for k, w in enumerate(fidelity.WEIGHTS))
add(
    "ms_ssim",
    lambda s, d: fidelity.multi_scale(tables.sheet(s, d)).selectExpr("image_id", "round(ms_ssim, 6) AS ms_ssim"),
    f"WITH {SHEET_SQL}, {_KERNEL}, {', '.join(_scale_sql(k) for k in range(5))} SELECT image_id, round({_PRODUCT}, 6) AS ms_ssim FROM (SELECT DISTINCT image_id FROM sheet) " + " ".join(f"LEFT JOIN m{k} USING (image_id)" for k in range(5)),
)
add(
    "ssim_windows",
    lambda s, d: fidelity.similarity(tables.sheet(s, d)).selectExpr("image_id", "round(ssim, 6) AS ssim", "round(structure, 6) AS structure", "windows"),
    f"WITH {SHEET_SQL}, {_KERNEL}, {_scale_sql(0)} SELECT image_id, round(avg({_STRUCTURE} * ({_LIKENESS})), 6) AS ssim, round(avg({_STRUCTURE}), 6) AS structure, count(*) AS windows FROM d0 GROUP BY 1",
)

# Bilateral filtering on a grid, each channel by itself.
_SPATIAL, _LEVELS = 3.0, 40.0
_STEP, _DEPTH = num(_SPATIAL * grids.CELL), num(_LEVELS * grids.CELL)
_PART = " * ".join(f"(CASE WHEN d{a} = 1 THEN g{a} - f{a} ELSE 1 - (g{a} - f{a}) END)" for a in "zyx")


def _blur_sql(k: int, axis: str) -> str:
    keys = ", ".join(f"{c} + o AS {c}" if c == axis else c for c in ("z", "v", "u"))
    return f"c{k} AS (SELECT image_id, channel, {keys}, sum(s * t.w0) AS s, sum(w * t.w0) AS w FROM c{k - 1}, (VALUES {', '.join(f'({i - 2}, {num(w)})' for i, w in enumerate(grids.KERNEL))}) t(o, w0) GROUP BY 1, 2, 3, 4, 5)"


add(
    "bilateral_grid",
    lambda s, d: grids.bilateral_grid(tables.rgba(s, d), _SPATIAL, _LEVELS, ("r", "g", "b")),
    f"""WITH {RGBA_SQL}, ch AS ({' UNION ALL '.join(f"SELECT {AT}, '{c}' AS channel, CAST({c} AS DOUBLE) AS l FROM px" for c in 'rgb')}),
p AS (SELECT *, y / {_STEP} AS gy, x / {_STEP} AS gx, (l - min(l) OVER (PARTITION BY image_id, channel)) / {_DEPTH} AS gz FROM ch),
f AS (SELECT *, CAST(floor(gz) AS INT) AS fz, CAST(floor(gy) AS INT) AS fy, CAST(floor(gx) AS INT) AS fx FROM p),
k AS (SELECT *, {_PART} AS k FROM f, (VALUES (0), (1)) a(dz), (VALUES (0), (1)) b(dy), (VALUES (0), (1)) c(dx)),
c0 AS (SELECT image_id, channel, fz + dz AS z, fy + dy AS v, fx + dx AS u, sum(k * l) AS s, sum(k) AS w FROM k GROUP BY 1, 2, 3, 4, 5), {_blur_sql(1, 'u')}, {_blur_sql(2, 'v')}, {_blur_sql(3, 'z')},
o AS (SELECT k.image_id, k.y, k.x, k.channel, k.l, sum(k * coalesce(s, 0)) AS s, sum(k * coalesce(w, 0)) AS w FROM k LEFT JOIN c3 ON c3.image_id = k.image_id AND c3.channel = k.channel AND z = fz + dz AND v = fy + dy AND u = fx + dx GROUP BY 1, 2, 3, 4, 5)
SELECT {AT}, {', '.join(f"max({byte('round(CASE WHEN w > 1e-12 THEN s / w ELSE l END, 5)')}) FILTER (channel = '{c}') AS {c}" for c in 'rgb')} FROM o GROUP BY 1, 2, 3""",
)

# Pages in photos; tests hold the corners against the ones that the photos were made with.
add("page_corners", lambda s, d: outlines.page_corners(tables.photos(s, d)).selectExpr("image_id", "posexplode_outer(quad) AS (corner, p)").selectExpr("image_id", "corner", "round(p.x, 6) AS x", "round(p.y, 6) AS y"))
add("page_alone", lambda s, d: outlines.page_alone(tables.photos(s, d), outlines.page_corners(tables.photos(s, d))))

# Resizing by mode, from each image's own size to its own target.
_MODES = {"stretch": (30, 12), "max": (30, 12), "min": (20, 12), "crop": (30, 12), "pad": (30, 12), "box_pad": (100, 10)}
_SAMPLER = "triangle"


def _fit_sql(mode: str, width: int, height: int) -> str:
    """image_id, out and draw sizes and places of each image, from s (image_id, height, width)."""
    fit, cover = f"least({width} / width::DOUBLE, {height} / height::DOUBLE)", f"greatest({width} / width::DOUBLE, {height} / height::DOUBLE)"
    scaled = lambda side, ratio: f"greatest(1, CAST(floor({side} * {ratio} + 0.5e0) AS INT))"
    ratio = {"max": fit, "min": f"least(1e0, {cover})", "crop": cover, "pad": fit, "box_pad": f"CASE WHEN width <= {width} AND height <= {height} THEN 1e0 ELSE {fit} END"}.get(mode)
    draw = (str(width), str(height)) if mode == "stretch" else (scaled("width", f"({ratio})"), scaled("height", f"({ratio})"))
    out = draw if mode in ("stretch", "max", "min") else (str(width), str(height))
    return f"fit AS (SELECT *, CAST(floor((ow - dw) / 2e0) AS INT) AS dx, CAST(floor((oh - dh) / 2e0) AS INT) AS dy FROM (SELECT image_id, width AS nw, height AS nh, {out[0]} AS ow, {out[1]} AS oh, {draw[0]} AS dw, {draw[1]} AS dh FROM s))"


def _own_taps_sql(name: str, source: str, target: str) -> str:
    """n, g, t, s, w: weights of each target place for every pair of sizes that occurs."""
    radius = num(kernels.SAMPLERS[_SAMPLER][0])
    return f"""{name} AS (
  SELECT n, g, t, s, w / sum(w) OVER (PARTITION BY n, g, t) AS w
  FROM (SELECT n, g, t, least(n - 1, greatest(0, o)) AS s, sum({_FILTERS[_SAMPLER]}) AS w
        FROM (SELECT *, (o - middle) / scale AS v
              FROM (SELECT *, unnest(generate_series(CAST(ceil(middle - {radius} * scale) AS BIGINT), CAST(floor(middle + {radius} * scale) AS BIGINT))) AS o
                    FROM (SELECT n, g, t, (t + 0.5e0) * n / g - 0.5e0 AS middle, greatest(1e0, n / g::DOUBLE) AS scale
                          FROM (SELECT DISTINCT {source} AS n, {target} AS g, unnest(generate_series(0, {target} - 1)) AS t FROM fit))))
        GROUP BY 1, 2, 3, 4))"""


for _mode, (_w, _h) in _MODES.items():
    _drawn = "small AS (SELECT p.image_id, d.t + dy AS y, c.t + dx AS x, " + ", ".join(f"{byte(f'round(sum(p.{k} * d.w * c.w), 6)')} AS {k}" for k in "rgb") + " FROM px p JOIN fit USING (image_id) JOIN dn d ON d.n = nh AND d.g = dh AND d.s = p.y JOIN ac c ON c.n = nw AND c.g = dw AND c.s = p.x GROUP BY 1, 2, 3)"
    _select = {
        "pad": f"SELECT k.image_id, CAST(k.v AS INT) AS y, CAST(k.u AS INT) AS x, coalesce(r, 9) AS r, coalesce(g, 0) AS g, coalesce(b, 7) AS b FROM (SELECT image_id, v, unnest(generate_series(0, {_w} - 1)) AS u FROM (SELECT image_id, unnest(generate_series(0, {_h} - 1)) AS v FROM fit)) k LEFT JOIN small q ON q.image_id = k.image_id AND q.y = k.v AND q.x = k.u",
        "plain": "SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, r, g, b FROM small JOIN fit USING (image_id) WHERE y >= 0 AND x >= 0 AND y < oh AND x < ow",
    }["pad" if _mode.endswith("pad") else "plain"]
    add(
        f"resize_mode_{_mode}",
        lambda s, d, m=_mode, w=_w, h=_h: geometry.resize_by_mode(tables.rgba(s, d), m, w, h, _SAMPLER, ("r", "g", "b"), {"r": 9, "b": 7}),
        f"WITH {RGBA_SQL}, {SIZE_SQL}, {_fit_sql(_mode, _w, _h)}, {_own_taps_sql('dn', 'nh', 'dh')}, {_own_taps_sql('ac', 'nw', 'dw')}, {_drawn} {_select}",
    )

# Equalisation in windows: levels by luma, colours scaled with them.
_TILES, _CLIP = 4, 6
_SCALED = [f"CASE WHEN l = 0 THEN {c} ELSE {byte(f'round({c} * (new / CAST(l AS DOUBLE)), 6)')} END AS {c}" for c in "rgb"]


def _sliding(s, d):
    px = tables.rgba(s, d).selectExpr("*", f"{luma()} AS l")
    return px.join(windows.equalize_sliding(px.select("image_id", "y", "x", "l"), _TILES, _CLIP).drop("l"), ["image_id", "y", "x"]).selectExpr("image_id", "y", "x", *_SCALED, "a")


add(
    "equalize_sliding",
    _sliding,
    f"""WITH {RGBA_SQL}, {SIZE_SQL}, v AS (SELECT px.*, {luma()} AS l, greatest(1, height // least({_TILES}, height)) // 2 AS hy, greatest(1, width // least({_TILES}, width)) // 2 AS hx FROM px JOIN s USING (image_id)),
h AS (SELECT p.image_id, p.y, p.x, p.l, q.l AS k, count(*) AS n FROM v p JOIN v q ON q.image_id = p.image_id AND q.y BETWEEN p.y - p.hy AND p.y + p.hy AND q.x BETWEEN p.x - p.hx AND p.x + p.hx GROUP BY 1, 2, 3, 4, 5),
o AS (SELECT *, CAST(sum(greatest(0, n - {_CLIP})) OVER (PARTITION BY image_id, y, x) AS BIGINT) AS over FROM h),
f AS (SELECT image_id, y, x, l, over // 256 AS each, over % 256 AS rest, sum(n) AS total, CAST(coalesce(sum(least(n, {_CLIP})) FILTER (k < l), 0) AS BIGINT) AS below, max(k) AS top, count(*) FILTER (k >= over % 256) AS beyond,
        coalesce(max(least(n, {_CLIP})) FILTER (k = 255), 0) AS at_end, arg_max(least(n, {_CLIP}), k) AS at_top, coalesce(max(least(n, {_CLIP})) FILTER (k = over % 256 - 1), 0) AS at_rest FROM o GROUP BY 1, 2, 3, 4, 5, 6),
m AS (SELECT *, below + l * each + least(l, rest) AS before, CASE WHEN each > 0 THEN 256 ELSE beyond + rest END AS occupied,
        total - CASE WHEN each > 0 THEN at_end + each WHEN top >= rest THEN at_top ELSE at_rest + 1 END AS others FROM f),
e AS (SELECT image_id, y, x, CASE WHEN occupied <= 1 OR others <= 0 THEN l ELSE CAST(least(255, floor((others / 255e0 / 2 + before) / (others / 255e0))) AS INT) END AS new FROM m)
SELECT {AT}, {', '.join(_SCALED)}, a FROM v JOIN e USING (image_id, y, x)""",
)

# The window that matters most; tests hold it against a plain loop.
add("smart_window", lambda s, d: crops.smart_window(tables.rgba(s, d), 24, 12, 0.7))
add("smart_crop", lambda s, d: crops.smart_crop(tables.rgba(s, d), 16, 16))

# Placeholder texts of 4 x 3 components, made, checked and made into pixels.
_FACTORS, _MOST, _TEXT = placeholders.steps(4, 3)
_HASHES = f"{RGBA_SQL}, {SIZE_SQL}, fac AS (SELECT image_id, {', '.join(f'{e} AS {n}' for n, e in _FACTORS.items())} FROM px JOIN s USING (image_id) GROUP BY 1), mos AS (SELECT *, {_MOST} AS most FROM fac), has AS (SELECT image_id, {_TEXT} AS hash FROM mos)"
add("blur_hash", lambda s, d: placeholders.blur_hash(tables.rgba(s, d)), f"WITH {_HASHES} SELECT image_id, hash FROM has")

#: Some of the texts spoilt: cut, with a strange digit, with another size, with a step out of range.
_SPOILT = "CASE CAST(image_id % 6 AS INT) WHEN 1 THEN substr(hash, 1, 27) WHEN 2 THEN concat('\"', substr(hash, 2)) WHEN 3 THEN concat('9', substr(hash, 2)) WHEN 4 THEN concat(substr(hash, 1, 26), '~~') WHEN 5 THEN 'L0' ELSE hash END"
_AT = lambda text, at, n: " + ".join(f"(strpos('{placeholders.DIGITS}', substr({text}, {at} + {k + 1}, 1)) - 1) * {83 ** (n - 1 - k)}" for k in range(n))
add(
    "blur_hash_valid",
    lambda s, d: placeholders.components(placeholders.blur_hash(tables.rgba(s, d)).selectExpr("image_id", f"{_SPOILT} AS hash")).selectExpr("image_id", "valid", "coalesce(components_x, 0) AS components_x", "coalesce(components_y, 0) AS components_y"),
    f"""WITH {_HASHES}, t AS (SELECT image_id, {_SPOILT} AS hash FROM has),
n AS (SELECT *, ({_AT('hash', 0, 1)}) % 9 + 1 AS nx, ({_AT('hash', 0, 1)}) // 9 + 1 AS ny, list_min(list_transform(string_split(hash, ''), lambda c: strpos('{placeholders.DIGITS}', c))) > 0 AS known FROM t),
v AS (SELECT *, known AND length(hash) >= 6 AND ny <= 9 AND length(hash) = 4 + 2 * nx * ny AND {_AT('hash', 2, 4)} <= 16777215 AND NOT list_contains(list_transform(range(1, nx * ny), lambda c: {_AT('hash', '(4 + 2 * c)', 2)} >= 6859), true) AS valid FROM n)
SELECT image_id, valid, CASE WHEN valid THEN CAST(nx AS INT) ELSE 0 END AS components_x, CASE WHEN valid THEN CAST(ny AS INT) ELSE 0 END AS components_y FROM v""",
)


def _wave(c: str, k: int) -> str:
    return f"sign(v // {19**k} % 19 - 9) * power((v // {19**k} % 19 - 9) / 9e0, 2) * most AS {c}"


_LIGHT = lambda v: f"CASE WHEN ({v}) / 255e0 <= 0.04045e0 THEN ({v}) / 255e0 / 12.92e0 ELSE power((({v}) / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END"
add(
    "blur_hash_pixels",
    lambda s, d: placeholders.from_blur_hash(placeholders.blur_hash(tables.rgba(s, d)), 20, 6),
    f"""WITH {_HASHES}, d AS (SELECT image_id, (({_AT('hash', 1, 1)}) + 1) / 166e0 AS most, {_AT('hash', 2, 4)} AS dc, hash FROM has),
c AS (SELECT image_id, 0 AS n, {', '.join(f"{_LIGHT(f'dc // {256**k} % 256')} AS {ch}" for ch, k in zip('rgb', (2, 1, 0), strict=True))} FROM d
  UNION ALL SELECT image_id, n, {', '.join(_wave(ch, k) for ch, k in zip('rgb', (2, 1, 0), strict=True))} FROM (SELECT image_id, most, u.n, {_AT('hash', '(4 + 2 * u.n)', 2)} AS v FROM d, generate_series(1, 11) u(n))),
w AS (SELECT image_id, y.v AS y, x.v AS x, {', '.join(f'round(sum({ch} * cos(pi() * x.v * (n % 4) / 20) * cos(pi() * y.v * (n // 4) / 6)), 9) AS {ch}' for ch in 'rgb')} FROM c, generate_series(0, 5) y(v), generate_series(0, 19) x(v) GROUP BY 1, 2, 3)
SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {', '.join(f"{from_unit(color.linear_to_srgb(clamp(ch, '0e0', '1e0')))} AS {ch}" for ch in 'rgb')} FROM w""",
)

# Neighbourhoods of all channels.
_BY_CHANNEL = ", ".join(f"c_{c} AS (SELECT image_id, y, x, {c} AS l FROM px)" for c in "rgb")


def _channels(name: str, kernel_list: dict[str, list], expr: str) -> None:
    """A query of convolutions; expr has {k} for the sums by name and {c} for the channel."""
    shown = {c: byte(f"round({expr.format(c=c, **{k: f'{c}_{k}' for k in kernel_list})}, 5)") for c in "rgb"}
    sums = ", ".join(f"s_{c}_{k} AS ({_gather(taps, f'c_{c}')})" for c in "rgb" for k, taps in kernel_list.items())
    joins = " ".join(f"JOIN (SELECT image_id, y, x, v AS {c}_{k} FROM s_{c}_{k}) USING (image_id, y, x)" for c in "rgb" for k in kernel_list)
    add(
        name,
        lambda s, d: lines.convolve_channels(tables.rgba(s, d), ("r", "g", "b"), kernel_list, keep=True).selectExpr("image_id", "y", "x", *(f"{e} AS {c}" for c, e in shown.items())),
        f"WITH {RGBA_SQL}, {_BY_CHANNEL}, {sums} SELECT {AT}, {', '.join(f'{e} AS {c}' for c, e in shown.items())} FROM px {joins}",
    )


def _square(weights: tuple) -> list[tuple[int, int, float]]:
    r = len(weights) // 2
    return [(i - r, j - r, a * b) for i, a in enumerate(weights) for j, b in enumerate(weights)]


for _edge in ("sobel", "prewitt", "scharr"):
    if _edge in kernels.EDGES_PAIR:
        _channels(f"edges_{_edge}_rgb", {k: kernels.taps(g) for k, g in zip("xy", kernels.EDGES_PAIR[_edge], strict=True)}, "sqrt({x} * {x} + {y} * {y})")
for _edge, _kernel in kernels.EDGES_SINGLE.items():
    _channels(f"edges_{_edge}_rgb", {"k": kernels.taps(_kernel)}, "{k}")
_channels("blur_box_rgb", {"v": _square(kernels.box(2))}, "{v}")
_channels("blur_gaussian_rgb", {"v": _square(kernels.gaussian(1.0))}, "{v}")
_channels("sharpen_gaussian_rgb", {"v": _square(kernels.gaussian(1.0))}, "2 * {c} - {v}")

_SHAPES = {"median_rgb": ("median", [(a, b) for a in range(-2, 3) for b in range(-2, 3)]), "erode_disk_rgb": ("min", gather.disk(2)), "dilate_cross_rgb": ("max", [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)])}
for _name, (_rank, _offsets) in _SHAPES.items():
    _pick = {"min": "min(q.l)", "max": "max(q.l)", "median": f"list_sort(list(q.l))[{len(_offsets) // 2 + 1}]"}[_rank]
    _sums = ", ".join(f"s_{c} AS ({_gather([(a, b, 1.0) for a, b in _offsets], f'c_{c}').replace('sum(q.l * t.c) AS v', f'{_pick} AS {c}')})" for c in "rgb")
    add(_name, lambda s, d, o=_offsets, k=_rank: lines.rank_channels(tables.rgba(s, d), ("r", "g", "b"), o, k), f"WITH {RGBA_SQL}, {_BY_CHANNEL}, {_sums} SELECT {AT}, r, g, b FROM s_r JOIN s_g USING (image_id, y, x) JOIN s_b USING (image_id, y, x)")

# A lens's blur: Spark runs complex kernels along both axes, the SQL sums over the whole disk's weights.
_RADIUS, _GAMMA = 2, 3.0
_DISK = [(i - _RADIUS, j - _RADIUS, sum((w * t[i] * t[j]).real for t, w in kernels.bokeh(_RADIUS, 3))) for i in range(2 * _RADIUS + 1) for j in range(2 * _RADIUS + 1)]
_POWERS = ", ".join(f"p_{c} AS (SELECT image_id, y, x, power({c} / 255e0, {num(_GAMMA if c != 'a' else 1.0)}) AS l FROM px)" for c in "rgba")
_LENS = {c: byte(f"round(power(least(1e0, greatest(0e0, l_{c})), {num(1 / _GAMMA if c != 'a' else 1.0)}) * 255, 5)") for c in "rgba"}
add(
    "bokeh_blur",
    lambda s, d: windows.bokeh_blur(tables.rgba(s, d), _RADIUS, 3, _GAMMA, ("r", "g", "b"), "a"),
    f"WITH {RGBA_SQL}, {_POWERS}, {', '.join(f'b_{c} AS ({_gather(_DISK, f'p_{c}')})' for c in 'rgba')} SELECT {AT}, {', '.join(f'{e} AS {c}' for c, e in _LENS.items())} FROM " + " JOIN ".join(f"(SELECT image_id, y, x, v AS l_{c} FROM b_{c})" + (" USING (image_id, y, x)" if c != "r" else "") for c in "rgba"),
)

# Which way up pages are, by sparse ink (levels under 40).
_INK = 40


def _sparse(s, d):
    return tables.gray(s, d).selectExpr("image_id", "y", "x", f"CASE WHEN l < {_INK} THEN 1 ELSE 0 END AS ink")


def _cues_sql(k: str, source: str) -> str:
    """lineness, asymmetry and lines of pages in source, as c{k}."""
    spread = lambda side: f"coalesce((SELECT avg(abs(q.v - CAST(list_sort({side}s)[len({side}s) // 2 + 1] AS DOUBLE))) FROM (SELECT unnest({side}s) AS v) q WHERE len({side}s) > 1), 0e0)"
    return f"""r{k} AS (SELECT image_id, y, sum(ink) AS n, min(x) FILTER (ink = 1) AS l, max(x) FILTER (ink = 1) AS r FROM {source} GROUP BY 1, 2),
e{k} AS (SELECT image_id, sum(n * n) AS energy, coalesce(sum(d * d), 0) AS changes FROM (SELECT *, n - lag(n) OVER (PARTITION BY image_id ORDER BY y) AS d FROM r{k}) GROUP BY 1),
i{k} AS (SELECT *, sum(s) OVER (PARTITION BY image_id ORDER BY y) AS line FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY image_id ORDER BY y) <= {upright.GAP + 1} THEN 0 ELSE 1 END AS s FROM r{k} WHERE n > 0)),
m{k} AS (SELECT *, n >= max(n) OVER (PARTITION BY image_id, line) * 0.5e0 AS core FROM i{k}),
f{k} AS (SELECT *, min(y) FILTER (core) OVER (PARTITION BY image_id, line) AS a, max(y) FILTER (core) OVER (PARTITION BY image_id, line) AS b FROM m{k}),
l{k} AS (SELECT image_id, line, coalesce(sum(n) FILTER (y < a), 0) AS above, coalesce(sum(n) FILTER (y > b), 0) AS below, min(l) AS l, max(r) AS r FROM f{k} GROUP BY 1, 2 HAVING max(y) - min(y) + 1 >= {upright.ROWS}),
p{k} AS (SELECT image_id, count(*) AS lines, sum(above) AS above, sum(below) AS below, list(l) AS lefts, list(r) AS rights FROM l{k} GROUP BY 1),
q{k} AS (SELECT image_id, lines, CAST(above AS DOUBLE) AS above, CAST(below AS DOUBLE) AS below, {spread('left')} AS sl, {spread('right')} AS sr FROM p{k}),
c{k} AS (SELECT e{k}.image_id, CASE WHEN energy > 0 THEN changes / CAST(energy AS DOUBLE) ELSE 0e0 END AS t{k}, coalesce(lines, 0) AS n{k},
  coalesce(0.6e0 * (CASE WHEN above + below > 1e-9 THEN (above - below) / (above + below) ELSE 0e0 END) + 0.4e0 * (CASE WHEN sr + sl > 1e-9 THEN (sr - sl) / (sr + sl) ELSE 0e0 END), 0e0) AS a{k} FROM e{k} LEFT JOIN q{k} USING (image_id))"""


_TEXT_SQL = f"""{GRAY_SQL}, page AS (SELECT image_id, y, x, CASE WHEN l < {_INK} THEN 1 ELSE 0 END AS ink FROM gray),
size AS (SELECT image_id, max(y) + 1 AS height, sum(ink) AS ink, count(*) AS n, greatest({upright.RULE}, least(max(x) + 1, max(y) + 1) // {upright.RULE_SHARE}) AS shortest FROM page GROUP BY 1),
ha AS (SELECT *, count(*) OVER (PARTITION BY image_id, y, g) AS len FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM page WHERE ink = 1)),
va AS (SELECT *, count(*) OVER (PARTITION BY image_id, x, g) AS len FROM (SELECT *, y - row_number() OVER (PARTITION BY image_id, x ORDER BY y) AS g FROM page WHERE ink = 1)),
rules AS (SELECT DISTINCT image_id, y, x FROM (SELECT * FROM ha UNION ALL SELECT * FROM va) JOIN size USING (image_id) WHERE len >= shortest),
txt AS (SELECT p.image_id, p.y, p.x, CASE WHEN r.image_id IS NOT NULL THEN 0 ELSE p.ink END AS ink FROM page p LEFT JOIN rules r ON r.image_id = p.image_id AND r.y = p.y AND r.x = p.x)"""
add(
    "page_orientation",
    lambda s, d: upright.orientation(_sparse(s, d)).selectExpr("image_id", "degrees", "round(confidence, 6) AS confidence"),
    f"""WITH {_TEXT_SQL},
trn AS (SELECT image_id, x AS y, height - 1 - y AS x, txt.ink FROM txt JOIN size USING (image_id)), {_cues_sql('0', 'txt')}, {_cues_sql('1', 'trn')},
v AS (SELECT image_id, ink, n, t0 >= t1 AS flat, CASE WHEN t0 >= t1 THEN a0 ELSE a1 END AS a, CASE WHEN t0 >= t1 THEN n0 ELSE n1 END AS k, CASE WHEN greatest(t0, t1) > 0 THEN (greatest(t0, t1) - least(t0, t1)) / (t0 + t1) ELSE 0e0 END AS c FROM size JOIN c0 USING (image_id) JOIN c1 USING (image_id))
SELECT image_id, CAST(CASE WHEN ink < {upright.INK} OR ink * 2 > n THEN 0 WHEN flat THEN CASE WHEN a >= 0 THEN 0 ELSE 180 END WHEN a >= 0 THEN 90 ELSE 270 END AS INT) AS degrees,
  CASE WHEN ink < {upright.INK} OR ink * 2 > n THEN 0e0 ELSE round(greatest(0e0, least(1e0, least(1e0, abs(a) * 1.5e0) * (0.4e0 + 0.6e0 * least(1e0, c * 2)) * (CASE WHEN k < 3 THEN 0.3e0 ELSE 1e0 END))), 6) END AS confidence FROM v""",
)

# Words: the SQL merges runs one after the other in a recursive table.
add("page_words", lambda s, d: layout.words(_sparse(s, d)), f"""WITH RECURSIVE {_TEXT_SQL},
ro AS (SELECT image_id, g, min(y) AS a, max(y) AS b FROM (SELECT image_id, y, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS g FROM (SELECT DISTINCT image_id, y FROM txt WHERE ink = 1)) GROUP BY 1, 2),
ru AS (SELECT image_id, a, b, row_number() OVER (PARTITION BY image_id ORDER BY a) AS k FROM ro),
mi AS (SELECT image_id, list_sort(list(b - a + 1))[count(*) // 2 + 1] AS middle FROM ru GROUP BY 1),
fo AS (
  SELECT image_id, k, a, b, 1 AS part FROM ru WHERE k = 1
  UNION ALL
  SELECT n.image_id, n.k, CASE WHEN j THEN f.a ELSE n.a END, n.b, CASE WHEN j THEN f.part ELSE f.part + 1 END
  FROM fo f JOIN ru n ON n.image_id = f.image_id AND n.k = f.k + 1 JOIN mi ON mi.image_id = f.image_id,
    LATERAL (SELECT ((n.b - n.a + 1) * 2 < middle OR (f.b - f.a + 1) * 2 < middle) AND n.a - f.b - 1 <= greatest(1, middle // 3) AS j)),
li AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY a) AS line, a, b FROM (SELECT image_id, part, min(a) AS a, max(b) AS b FROM fo GROUP BY 1, 2) WHERE b - a + 1 >= {layout.LOWEST}),
co AS (SELECT t.image_id, line, greatest({layout.WORD_GAP}, CAST(round_even((b - a + 1) * {num(layout.GAP_SHARE)}, 0) AS INT)) AS gap, t.x, min(t.y) AS y0, max(t.y) AS y1 FROM txt t JOIN li ON li.image_id = t.image_id AND t.y BETWEEN a AND b WHERE t.ink = 1 GROUP BY 1, 2, 3, 4),
st AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY image_id, line ORDER BY x) - 1 < gap THEN 0 ELSE 1 END AS s FROM co),
wo AS (SELECT *, sum(s) OVER (PARTITION BY image_id, line ORDER BY x) AS word FROM st)
SELECT image_id, CAST(line AS INT) AS line, CAST(word AS INT) AS word, min(x) AS "left", min(y0) AS top, max(x) + 1 AS "right", max(y1) + 1 AS bottom FROM wo GROUP BY 1, 2, 3""")

# Packed placeholders; the SQL makes the same sums and packs them with lists.
_OVER = ", ".join(f"{e} AS {'or_' if c == 'or' else c}" for c, e in thumbs.OVER.items())
_WAVES = {c: thumbs.waves(n) for c, n in (("l", thumbs.LIGHT), ("p", thumbs.TINTS), ("q", thumbs.TINTS), ("o", thumbs.ALPHA))}
_whole = lambda e: f"CAST(floor(round({e}, 9) + 0.5e0) AS INT)"


def _kept_sql(c: str) -> str:
    rows = "[" + ", ".join(f"{{'i': {i}, 'j': {j}, 'f': {c}_{i}_{j}}}" for i, j in _WAVES[c] if i or j) + "]"
    some = f"list_filter({rows}, lambda w: w.i * greatest(3, ly) < greatest(3, lx) * (greatest(3, ly) - w.j))" if c == "l" else rows
    return f"list_transform({some}, lambda w: w.f) AS w{c}"


def _halves_sql(c: str) -> str:
    return f"list_transform(w{c}, lambda f: CASE WHEN s{c} > 0 THEN {_whole(f'15 * (0.5e0 + 0.5e0 / s{c} * f)')} ELSE {_whole('15 * f')} END)"


_digit = lambda e: f"substr('0123456789abcdef', CAST({e} AS INT) + 1, 1)"
_pair = lambda e: f"{_digit(f'({e}) // 16 % 16')} || {_digit(f'({e}) % 16')}"
_THUMBS = f"""{RGBA_SQL}, tf AS (SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, sum(a) < 255 * count(*) AS clear, {', '.join(thumbs.MEANS)} FROM px GROUP BY 1),
ts AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in thumbs.SHAPE.items())} FROM tf),
tv AS (SELECT image_id, y, x, a, width, height, clear, lx, ly, {_OVER} FROM px JOIN ts USING (image_id)),
tw AS (SELECT image_id, width, height, clear, lx, ly, {', '.join(f'{thumbs.wave(c, i, j)} AS {c}_{i}_{j}' for c, at in _WAVES.items() for i, j in at)} FROM tv GROUP BY 1, 2, 3, 4, 5, 6),
tk AS (SELECT *, {', '.join(map(_kept_sql, _WAVES))} FROM tw),
tx AS (SELECT *, {', '.join(f'coalesce(list_max(list_transform(w{c}, lambda f: abs(f))), 0e0) AS s{c}' for c in _WAVES)} FROM tk),
tn AS (SELECT image_id, {_whole('63 * l_0_0')} + {_whole('31.5e0 + 31.5e0 * p_0_0')} * 64 + {_whole('31.5e0 + 31.5e0 * q_0_0')} * 4096 + {_whole('31 * sl')} * 262144 + CASE WHEN clear THEN 8388608 ELSE 0 END AS h1,
  CASE WHEN width > height THEN ly + 32768 ELSE lx END + {_whole('63 * sp')} * 8 + {_whole('63 * sq')} * 512 AS h2,
  CASE WHEN clear THEN [{_whole('15 * o_0_0')}, {_whole('15 * so')}] ELSE [] END || {_halves_sql('l')} || {_halves_sql('p')} || {_halves_sql('q')} || CASE WHEN clear THEN {_halves_sql('o')} ELSE [] END AS n FROM tx),
th AS (SELECT image_id, {_pair('h1 % 256')} || {_pair('h1 // 256 % 256')} || {_pair('h1 // 65536 % 256')} || {_pair('h2 % 256')} || {_pair('h2 // 256')} || array_to_string(list_transform(range(0, (len(n) + 1) // 2), lambda k: {_digit('coalesce(n[2 * k + 2], 0)')} || {_digit('n[2 * k + 1]')}), '') AS hash FROM tn)"""
add("thumb_hash", lambda s, d: thumbs.thumb_hash(tables.rgba(s, d)), f"WITH {_THUMBS} SELECT image_id, hash FROM th")
_AVERAGE = {"b": "l - 2e0 / 3 * p", "r": "(3 * l - (l - 2e0 / 3 * p) + q) / 2", "g": "(3 * l - (l - 2e0 / 3 * p) + q) / 2 - q", "a": "o"}
add(
    "thumb_hash_mean",
    lambda s, d: thumbs.mean_colour(thumbs.thumb_hash(tables.rgba(s, d))),
    f"""WITH {_THUMBS}, tm AS (SELECT image_id, h1 % 64 / 63e0 AS l, h1 // 64 % 64 / 31.5e0 - 1 AS p, h1 // 4096 % 64 / 31.5e0 - 1 AS q, CASE WHEN h1 >= 8388608 THEN n[1] / 15e0 ELSE 1e0 END AS o,
  CASE WHEN h1 >= 8388608 THEN {thumbs.LIGHT_OVER} ELSE {thumbs.LIGHT} END AS most, h2 % 8 AS given, h2 >= 32768 AS wide FROM tn)
SELECT image_id, {', '.join(f"CAST(floor(round(greatest(0e0, least(1e0, {e})) * 255, 6) + 0.5e0) AS INT) AS {c}" for c, e in _AVERAGE.items())}, round(CASE WHEN wide THEN most / CAST(given AS DOUBLE) ELSE given / CAST(most AS DOUBLE) END, 6) AS aspect FROM tm""",
)
add("thumb_hash_pixels", lambda s, d: thumbs.from_thumb_hash(thumbs.thumb_hash(tables.rgba(s, d)), 16))

# Tags of EXIF blocks that are made from suppliers; the SQL states what was put in.
_TAGS = [
    ("image", 256, 4, 1, "''", "100 + k % 500"), ("image", 271, 2, 19, "name", None), ("image", 274, 3, 1, "''", "k % 8 + 1"), ("image", 282, 5, 1, "''", "CASE WHEN k % 7 > 0 THEN (k * 10 + 1) / CAST(k % 7 AS DOUBLE) END"), ("image", 306, 2, 20, "'2024:05:06 07:08:09'", None),
    ("image", 34665, 4, 1, "''", "146"), ("image", 34853, 4, 1, "''", "184"), ("photo", 33434, 10, 1, "''", "-k / 8e0"), ("photo", 34855, 3, 2, "''", "100 * (k % 9), s_nationkey"), ("gps", 1, 7, 2, "CASE WHEN k % 2 = 0 THEN '4e00' ELSE '4d00' END", None), ("gps", 2, 5, 3, "''", "k % 90, k % 60, k % 59 / 10e0"),
]
_shown_numbers = lambda v: "''" if v is None else " || ' ' || ".join(f"coalesce(printf('%.6f', CAST({e} AS DOUBLE)), '-')" for e in v.split(", "))
add(
    "exif_tags",
    lambda s, d: metadata.exif_tags(tables.exif_blocks(s, d)).selectExpr("image_id", "directory", "tag", "type", "count", "coalesce(text, '') AS text", "coalesce(array_join(transform(numbers, v -> CASE WHEN v IS NULL THEN '-' ELSE printf('%.6f', v) END), ' '), '') AS numbers"),
    "WITH t AS (SELECT *, s_suppkey AS k, rpad(s_name, 18, '.') AS name FROM supplier) " + " UNION ALL ".join(f"SELECT k AS image_id, '{directory}' AS directory, {tag} AS tag, {kind} AS type, CAST({count} AS BIGINT) AS count, {text} AS text, {_shown_numbers(numbers)} AS numbers FROM t" for directory, tag, kind, count, text, numbers in _TAGS),
)
