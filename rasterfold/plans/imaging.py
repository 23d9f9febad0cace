"""Queries over images, each with the SQL of another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterfold.functions import color, kernels
from rasterfold.functions.numbers import byte, luma, num
from rasterfold.operators import compose, geometry, lines, pixels, thresholds
from rasterfold.sources import tables
from rasterfold.sources.tables import GRAY_SQL, HEIGHT, INK_SQL, PAIR_SQL, RGBA_SQL, WIDTH

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AT = "image_id, y, x"


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name] = query
    SQL[name] = sql


def _projection(name: str, channels: dict[str, str], digits: int | None = None) -> None:
    """Channels in both engines; r, g, b, a that aren't named stay, unless the channels are new ones."""
    shown = {c: e if digits is None else f"round({e}, {digits})" for c, e in channels.items()}
    kept = [c for c in "rgba" if c not in shown] if set(shown) & set("rgba") else []
    exprs = [f"{e} AS {c}" for c, e in shown.items()] + kept
    add(name, lambda s, d: tables.rgba(s, d).selectExpr("image_id", "y", "x", *exprs), f"WITH {RGBA_SQL} SELECT {AT}, {', '.join(exprs)} FROM px")


_projection("grayscale", color.grayscale())
_projection("invert", color.invert())
_projection("background_color", color.background(32, 64, 96))
_projection("gamma", color.gamma(2.2))
for _name, _matrix in {
    **color.MATRICES, "brightness": color.scale_matrix(1.2), "contrast": color.contrast_matrix(1.3), "hue": color.hue_matrix(60), "saturate": color.saturate_matrix(1.5), "lightness": color.lightness_matrix(1.1),
    "opacity": color.opacity_matrix(0.5), "sepia": color.sepia_matrix(), "invert_amount": color.invert_matrix(0.7), "grayscale_bt601": color.grayscale_matrix(0.8, "bt601"), "grayscale_bt709": color.grayscale_matrix(0.6),
}.items():
    _projection(f"filter_{_name}", color.apply_matrix(_matrix))
for _curve in ("clip", "reinhard", "reinhard_extended", "aces", "hable"):
    _projection(f"tone_map_{_curve}", color.tone_map(_curve, 0.5))
#: Each image's own size, for SQL; SIZED_SQL has px with it.
SIZE_SQL = "s AS (SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width FROM px GROUP BY 1)"
SIZED_SQL = f"{RGBA_SQL}, {SIZE_SQL}"
for _name, _shown in {"vignette": color.vignette((0, 10, 0), "width", "height"), "glow": color.glow((255, 153, 102), "width", "height")}.items():
    _exprs = [f"{e} AS {c}" for c, e in _shown.items()] + [c for c in "rgba" if c not in _shown]
    add(_name, lambda s, d, e=_exprs: pixels.sized(tables.rgba(s, d)).selectExpr("image_id", "y", "x", *e), f"WITH {SIZED_SQL} SELECT {AT}, {', '.join(_exprs)} FROM px JOIN s USING (image_id)")
for _name, _space in {"xyz": color.xyz(), "lab": color.lab(), "lch": {k: e for k, e in color.lch().items() if k != "lch_h"}, "oklab": color.oklab(), "hsv": color.hsv(), "hsl": color.hsl(), "linear": {f"lin_{c}": color.linear(c) for c in "rgb"}}.items():
    _projection(f"color_{_name}", {f"out_{c}": e for c, e in _space.items()}, 6)
_projection("pixel_l8", {"l8": luma()})
_projection("pixel_l16", {"l16": f"{luma()} * 257"})
_projection("pixel_rgb565", {"packed": f"{byte('r * 31 / 255e0')} * 2048 + {byte('g * 63 / 255e0')} * 32 + {byte('b * 31 / 255e0')}"})
_projection("pixel_argb", {"packed": "CAST(a AS BIGINT) * 16777216 + r * 65536 + g * 256 + b"})
_projection("tensor_chw", {f"t_{c}": f"({c} / 255e0 - {num(m)}) / {num(s)}" for c, m, s in zip("rgb", (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), strict=True)} | {f"at_{c}": f"{k} * {HEIGHT * WIDTH} + y * {WIDTH} + x" for k, c in enumerate("rgb")}, 6)
_projection("tensor_hwc", {f"t_{c}": f"{c} / 127.5e0 - 1" for c in "rgb"} | {f"at_{c}": f"(y * {WIDTH} + x) * 3 + {k}" for k, c in enumerate("rgb")}, 6)
_projection("threshold_luminance", dict.fromkeys("rgb", f"CASE WHEN {luma()} >= 128 THEN 255 ELSE 0 END"))
_projection("threshold_saturation", dict.fromkeys("rgb", f"CASE WHEN {color.hsl()['s']} >= 0.5e0 THEN 255 ELSE 0 END"))
_projection("threshold_max_chroma", dict.fromkeys("rgb", "CASE WHEN greatest(abs(r - 128), abs(g - 128), abs(b - 128)) >= 64 THEN 255 ELSE 0 END"))


def _region(s: SparkSession, d: str) -> DataFrame:
    return pixels.within(tables.rgba(s, d), (8, 4, 20, 6), color.invert())


_inside = "x BETWEEN 8 AND 27 AND y BETWEEN 4 AND 9"
add("region_invert", _region, f"WITH {RGBA_SQL} SELECT {AT}, " + ", ".join(f"CASE WHEN {_inside} THEN 255 - {c} ELSE {c} END AS {c}" for c in "rgb") + ", a FROM px")

# Geometry: coordinates only, by each image's own size.
for _name, _y, _x, _where, _move in (
    ("crop", "y - 2", "x - 10", "y BETWEEN 2 AND 11 AND x BETWEEN 10 AND 49", lambda px: geometry.crop(px, (10, 2, 40, 10))),
    ("flip_horizontal", "y", "width - 1 - x", "true", lambda px: geometry.flip(px, "horizontal")),
    ("flip_vertical", "height - 1 - y", "x", "true", lambda px: geometry.flip(px, "vertical")),
    ("rotate_90", "x", "height - 1 - y", "true", lambda px: geometry.turn(px, 90)),
    ("rotate_180", "height - 1 - y", "width - 1 - x", "true", lambda px: geometry.turn(px, 180)),
    ("rotate_270", "width - 1 - x", "y", "true", lambda px: geometry.turn(px, 270)),
    ("transpose", "x", "y", "true", geometry.transpose),
):
    add(_name, lambda s, d, m=_move: m(tables.rgba(s, d)), f"WITH {SIZED_SQL} SELECT image_id, {_y} AS y, {_x} AS x, r, g, b, a FROM px JOIN s USING (image_id) WHERE {_where}")

_TAG = "image_id % 8 + 1"
_oy = f"CASE WHEN {_TAG} IN (3, 4) THEN height - 1 - y WHEN {_TAG} IN (5, 6) THEN x WHEN {_TAG} IN (7, 8) THEN width - 1 - x ELSE y END"
_ox = f"CASE WHEN {_TAG} IN (2, 3) THEN width - 1 - x WHEN {_TAG} IN (5, 8) THEN y WHEN {_TAG} IN (6, 7) THEN height - 1 - y ELSE x END"
add("auto_orient", lambda s, d: geometry.orient(tables.rgba(s, d), F.expr(_TAG)), f"WITH {SIZED_SQL} SELECT image_id, {_oy} AS y, {_ox} AS x, r, g, b, a FROM px JOIN s USING (image_id)")


def _canvas_sql(width: int, height: int) -> str:
    return f"canvas AS (SELECT image_id, CAST(u.y AS INT) AS y, CAST(v.x AS INT) AS x FROM (SELECT DISTINCT image_id FROM px) i, generate_series(0, {height - 1}) u(y), generate_series(0, {width - 1}) v(x))"


def _pad(s: SparkSession, d: str) -> DataFrame:
    return geometry.place(tables.rgba(s, d), WIDTH + 16, HEIGHT + 8, (8, 4), {"r": 10, "g": 20, "b": 30, "a": 255})


add("pad", _pad, f"WITH {RGBA_SQL}, {_canvas_sql(WIDTH + 16, HEIGHT + 8)} SELECT c.image_id, c.y, c.x, coalesce(r, 10) AS r, coalesce(g, 20) AS g, coalesce(b, 30) AS b, coalesce(a, 255) AS a FROM canvas c LEFT JOIN px p ON p.image_id = c.image_id AND p.y + 4 = c.y AND p.x + 8 = c.x")

add("resize_nearest", lambda s, d: geometry.resize_nearest(tables.rgba(s, d), 40, 10), f"WITH {SIZED_SQL}, {_canvas_sql(40, 10)} SELECT c.image_id, c.y, c.x, r, g, b, a FROM canvas c JOIN s USING (image_id) JOIN px p ON p.image_id = c.image_id AND p.y = c.y * s.height // 10 AND p.x = c.x * s.width // 40")


_SINC = "(CASE WHEN abs({0}) < 1e-6 THEN 1e0 ELSE sin(pi() * ({0})) / (pi() * ({0})) END)"


def _cubic_sql(b: float, c: float) -> str:
    near = f"(({num(12 - 9 * b - 6 * c)}) * power(abs(v), 3) + ({num(-18 + 12 * b + 6 * c)}) * power(v, 2) + {num(6 - 2 * b)}) / 6"
    far = f"(({num(-b - 6 * c)}) * power(abs(v), 3) + ({num(6 * b + 30 * c)}) * power(v, 2) + ({num(-12 * b - 48 * c)}) * abs(v) + {num(8 * b + 24 * c)}) / 6"
    return f"CASE WHEN abs(v) < 1 THEN {near} WHEN abs(v) < 2 THEN {far} ELSE 0e0 END"


def _lanczos_sql(n: int) -> str:
    return f"CASE WHEN abs(v) < {n} THEN {_SINC.format('v')} * {_SINC.format(f'v / {n}')} ELSE 0e0 END"


#: The filters again, as SQL over the distance v.
_FILTERS = {
    "box": "CASE WHEN v > -0.5e0 AND v <= 0.5e0 THEN 1e0 ELSE 0e0 END", "triangle": "greatest(0e0, 1 - abs(v))", "bilinear": "greatest(0e0, 1 - abs(v))", "hermite": "CASE WHEN abs(v) < 1 THEN (2 * abs(v) - 3) * v * v + 1 ELSE 0e0 END",
    "bicubic": _cubic_sql(0, 0.5), "catmull_rom": _cubic_sql(0, 0.5), "mitchell_netravali": _cubic_sql(1 / 3, 1 / 3), "robidoux": _cubic_sql(0.37821575509399867, 0.31089212245300067), "robidoux_sharp": _cubic_sql(0.2620145123990142, 0.3689927438004929), "spline": _cubic_sql(1, 0),
    "lanczos2": _lanczos_sql(2), "lanczos3": _lanczos_sql(3), "lanczos5": _lanczos_sql(5), "lanczos8": _lanczos_sql(8), "welch": f"CASE WHEN abs(v) < 3 THEN {_SINC.format('v')} * (1 - v * v / 9) ELSE 0e0 END",
}


def _taps_sql(name: str, sizes: str, target: int, sampler: str) -> str:
    """n (source size), t, s, w: weights of each target place, made in SQL for every size that occurs."""
    radius = kernels.SAMPLERS[sampler][0]
    return f"""{name} AS (
  SELECT n, t, s, w / sum(w) OVER (PARTITION BY n, t) AS w
  FROM (SELECT n, t, least(n - 1, greatest(0, o)) AS s, sum({_FILTERS[sampler]}) AS w
        FROM (SELECT *, (o - middle) / scale AS v
              FROM (SELECT *, unnest(generate_series(CAST(ceil(middle - {num(radius)} * scale) AS BIGINT), CAST(floor(middle + {num(radius)} * scale) AS BIGINT))) AS o
                    FROM (SELECT n, t, (t + 0.5e0) * n / {target} - 0.5e0 AS middle, greatest(1e0, n / {num(target)}) AS scale FROM ({sizes}), generate_series(0, {target - 1}) u(t))))
        GROUP BY 1, 2, 3))"""


def _resize(sampler: str, width: int, height: int) -> None:
    sql = f"""WITH {GRAY_SQL}, hs AS (SELECT image_id, max(y) + 1 AS n FROM gray GROUP BY 1), {_taps_sql('dn', 'SELECT DISTINCT n FROM hs', height, sampler)}, {_taps_sql('ac', f'SELECT {WIDTH} AS n', width, sampler)}
SELECT image_id, CAST(dn.t AS INT) AS y, CAST(ac.t AS INT) AS x, {byte('round(sum(l * dn.w * ac.w), 6)')} AS l
FROM gray JOIN hs USING (image_id) JOIN dn ON dn.n = hs.n AND dn.s = y JOIN ac ON ac.s = x GROUP BY 1, 2, 3"""
    add(f"resize_{sampler}", lambda s, d: geometry.resize(tables.gray(s, d), width, height, sampler), sql)


for _sampler in kernels.SAMPLERS:
    _resize(_sampler, 24, 8)

add(
    "downscale_integer",
    lambda s, d: tables.gray(s, d).groupBy("image_id", F.expr("y div 4").alias("y"), F.expr("x div 4").alias("x")).agg(F.floor(F.avg("l") + 0.5).cast("int").alias("l")),
    f"WITH {GRAY_SQL} SELECT image_id, CAST(y // 4 AS BIGINT) AS y, CAST(x // 4 AS BIGINT) AS x, CAST(floor(avg(l) + 0.5e0) AS INT) AS l FROM gray GROUP BY 1, 2, 3",
)
add(
    "pixelate",
    lambda s, d: tables.gray(s, d).select("image_id", "y", "x", F.floor(F.avg("l").over(W.partitionBy("image_id", F.expr("y div 5"), F.expr("x div 5"))) + 0.5).cast("int").alias("l")),
    f"WITH {GRAY_SQL} SELECT {AT}, CAST(floor(avg(l) OVER (PARTITION BY image_id, y // 5, x // 5) + 0.5e0) AS INT) AS l FROM gray",
)


# Compositing: an image over another, at a place and with a share.
def _compose(name: str, blend: str, composition: str) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        px = tables.rgba(s, d)
        return compose.draw(px, px.selectExpr("image_id", "y", "x", "g AS r", "b AS g", "r AS b", "a"), (5, 2), 0.5, blend, composition)

    add(name, query, f"""WITH {RGBA_SQL}, both_px AS (
  SELECT p.image_id, p.y, p.x, p.r / 255e0 AS br, p.g / 255e0 AS bg, p.b / 255e0 AS bb, p.a / 255e0 AS ba,
         coalesce(o.g / 255e0, 0e0) AS sr, coalesce(o.b / 255e0, 0e0) AS sg, coalesce(o.r / 255e0, 0e0) AS sb, coalesce(o.a / 255e0 * 0.5e0, 0e0) AS sa
  FROM px p LEFT JOIN px o ON o.image_id = p.image_id AND o.y + 2 = p.y AND o.x + 5 = p.x)
SELECT {AT}, {', '.join(f'{e} AS {c}' for c, e in color.composed(blend, composition).items())} FROM both_px""")


for _blend in color.BLENDS:
    _compose(f"blend_{_blend}", _blend, "src_over")
for _composition in color.COMPOSITIONS:
    _compose(f"compose_{_composition}", "multiply", _composition)


# Neighbourhoods: the SQL gathers pixel by pixel, Spark line by line.
def _gather(rows: list[tuple[int, int, float]], table: str = "gray") -> str:
    """Sums over taps (dy, dx, weight) with clamped edges."""
    return f"""SELECT p.image_id, p.y, p.x, sum(q.l * t.c) AS v
FROM {table} p JOIN (SELECT image_id, max(y) AS bottom FROM {table} GROUP BY 1) h USING (image_id) CROSS JOIN (SELECT * FROM (VALUES {', '.join(f'({a}, {b}, {num(w)})' for a, b, w in rows)}) v(a, b, c)) t
JOIN {table} q ON q.image_id = p.image_id AND q.y = least(h.bottom, greatest(0, p.y + t.a)) AND q.x = least({WIDTH - 1}, greatest(0, p.x + t.b)) GROUP BY 1, 2, 3"""


def _convolution(name: str, kernel_list: dict[str, list], expr: str) -> None:
    joins = " JOIN ".join([f"({_gather(t)}) s{i}" + (" USING (image_id, y, x)" if i else "") for i, t in enumerate(kernel_list.values())])
    spark_cols = {k: f"k{i}" for i, k in enumerate(kernel_list)}
    renamed = {spark_cols[k]: t for k, t in kernel_list.items()}
    sql_expr, spark_expr = expr, expr
    for i in range(len(kernel_list)):
        sql_expr = sql_expr.replace(f"k{i}", f"s{i}.v")
    add(name, lambda s, d: lines.convolve(tables.gray(s, d), "l", renamed).selectExpr("image_id", "y", "x", f"{spark_expr} AS l"), f"WITH {GRAY_SQL} SELECT {AT}, {sql_expr} AS l FROM {joins}")


for _name, _kernel in kernels.EDGES_SINGLE.items():
    _convolution(f"edges_{_name}", {"k": kernels.taps(_kernel)}, byte("round(k0, 6)"))
for _name, (_gx, _gy) in kernels.EDGES_PAIR.items():
    _convolution(f"edges_{_name}", {"x": kernels.taps(_gx), "y": kernels.taps(_gy)}, byte("round(sqrt(k0 * k0 + k1 * k1), 6)"))
for _name, _north in kernels.EDGES_COMPASS.items():
    _turns = {f"d{i}": kernels.taps(k) for i, k in enumerate(kernels.compass(_north))}
    _convolution(f"edges_{_name}", _turns, byte(f"round(greatest({', '.join(f'k{i}' for i in range(8))}), 6)"))
_convolution("convolve", {"k": kernels.taps(((1, 2, 1), (0, 3, 0), (2, 1, 2)))}, byte("round(k0 / 12, 6)"))


def _blur(name: str, weights: tuple, expr: str = "v") -> None:
    r = len(weights) // 2
    square = [(i - r, j - r, a * b) for i, a in enumerate(weights) for j, b in enumerate(weights)]
    shown = byte(f"round({expr}, 5)")
    add(
        name,
        lambda s, d: lines.separable(tables.gray(s, d), "l", weights, "v", keep=True).selectExpr("image_id", "y", "x", f"{shown} AS l"),
        f"WITH {GRAY_SQL} SELECT b.image_id, b.y, b.x, {shown} AS l FROM ({_gather(square)}) b JOIN gray g USING (image_id, y, x)",
    )


_blur("blur_box", kernels.box(2))
_blur("blur_gaussian", kernels.gaussian(1.0))
_blur("sharpen_gaussian", kernels.gaussian(1.0), "2 * l - v")

_SQUARE = [(a, b, 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def _rank_sql(rank: str, table: str = "gray") -> str:
    pick = {"min": "min(q.l)", "max": "max(q.l)", "median": "list_sort(list(q.l))[5]"}[rank]
    return _gather(_SQUARE, table).replace("sum(q.l * t.c) AS v", f"{pick} AS l")


def _chain(*ranks: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        px = tables.gray(s, d)
        for rank in ranks:
            px = lines.rank_filter(px, "l", 1, rank, "l")
        return px

    return query


add("median_blur", _chain("median"), f"WITH {GRAY_SQL} {_rank_sql('median')}")
add("erode", _chain("min"), f"WITH {GRAY_SQL} {_rank_sql('min')}")
add("dilate", _chain("max"), f"WITH {GRAY_SQL} {_rank_sql('max')}")
_OPENED, _CLOSED = f"e AS ({_rank_sql('min')}), o AS ({_rank_sql('max', 'e')})", f"e AS ({_rank_sql('max')}), o AS ({_rank_sql('min', 'e')})"
add("open", _chain("min", "max"), f"WITH {GRAY_SQL}, {_OPENED} SELECT {AT}, l FROM o")
add("close", _chain("max", "min"), f"WITH {GRAY_SQL}, {_CLOSED} SELECT {AT}, l FROM o")


def _hat(ranks: tuple[str, str], expr: str) -> Query:
    return lambda s, d: tables.gray(s, d).join(_chain(*ranks)(s, d).withColumnRenamed("l", "o"), ["image_id", "y", "x"]).selectExpr("image_id", "y", "x", f"{expr} AS l")


add("top_hat", _hat(("min", "max"), "l - o"), f"WITH {GRAY_SQL}, {_OPENED} SELECT {AT}, gray.l - o.l AS l FROM gray JOIN o USING (image_id, y, x)")
add("black_hat", _hat(("max", "min"), "o - l"), f"WITH {GRAY_SQL}, {_CLOSED} SELECT {AT}, o.l - gray.l AS l FROM gray JOIN o USING (image_id, y, x)")

# Thresholds.
_HIST = "h AS (SELECT image_id, l AS level, count(*) AS n FROM gray GROUP BY 1, 2)"
_OTSU = f"""{_HIST},
c AS (SELECT image_id, level, sum(n) OVER u AS w0, sum(n * level) OVER u AS s0, sum(n) OVER (PARTITION BY image_id) AS w, sum(n * level) OVER (PARTITION BY image_id) AS s FROM h WINDOW u AS (PARTITION BY image_id ORDER BY level)),
v AS (SELECT image_id, level, CAST(w0 AS DOUBLE) * (w - w0) * power(s0 / CAST(w0 AS DOUBLE) - (s - s0) / CAST(w - w0 AS DOUBLE), 2) AS v FROM c WHERE w0 < w),
t AS (SELECT image_id, coalesce(arg_max(level, (v, -level)), 127) AS t FROM (SELECT DISTINCT image_id FROM h) LEFT JOIN v USING (image_id) GROUP BY 1)"""
add("threshold_otsu", lambda s, d: thresholds.otsu(tables.gray(s, d)), f"WITH {GRAY_SQL}, {_OTSU} SELECT image_id, CAST(t AS INT) AS t FROM t")
add("binarize_otsu", lambda s, d: thresholds.otsu_threshold(tables.gray(s, d)), f"WITH {GRAY_SQL}, {_OTSU} SELECT {AT}, CASE WHEN l > t THEN 255 ELSE 0 END AS l FROM gray JOIN t USING (image_id)")
add(
    "integral_image",
    lambda s, d: thresholds.integral(tables.gray(s, d)),
    f"WITH {GRAY_SQL}, a AS (SELECT *, sum(l) OVER (PARTITION BY image_id, y ORDER BY x) AS s, sum(l * l) OVER (PARTITION BY image_id, y ORDER BY x) AS q FROM gray) SELECT {AT}, CAST(sum(s) OVER (PARTITION BY image_id, x ORDER BY y) AS BIGINT) AS sum, CAST(sum(q) OVER (PARTITION BY image_id, x ORDER BY y) AS BIGINT) AS sum2 FROM a",
)
for _method, _test in thresholds.LOCAL.items():
    _r = 7
    _stats = f"""b AS (SELECT p.image_id, p.y, p.x, any_value(p.l) AS l, sum(q.l) AS s, sum(q.l * q.l) AS q, count(*) AS n FROM gray p JOIN gray q ON q.image_id = p.image_id AND q.y BETWEEN p.y - {_r} AND p.y + {_r} AND q.x BETWEEN p.x - {_r} AND p.x + {_r} GROUP BY 1, 2, 3),
st AS (SELECT {AT}, l, n, {thresholds.MEAN} AS m, {thresholds.STD} AS d FROM b), g AS (SELECT *, min(l) OVER (PARTITION BY image_id) AS lo, max(d) OVER (PARTITION BY image_id) AS dmax FROM st)"""
    add(f"threshold_{_method}", lambda s, d, m=_method: thresholds.local_threshold(tables.gray(s, d), m, 7), f"WITH {GRAY_SQL}, {_stats} SELECT {AT}, CASE WHEN {_test} THEN 255 ELSE 0 END AS l FROM g")

# Ordered dithers to black and white.
for _name, _m in {"bayer_2x2": kernels.bayer(2), "bayer_4x4": kernels.bayer(4), "bayer_8x8": kernels.bayer(8), "bayer_16x16": kernels.bayer(16), "ordered_3x3": kernels.ORDERED_3}.items():
    _n = len(_m)
    _flat = ", ".join(str(v) for row in _m for v in row)
    _place = f"CAST((y % {_n}) * {_n} + x % {_n} + 1 AS INT)"
    _rule = f"CASE WHEN l + 255e0 * (({{}} + 0.5e0) / {_n * _n} - 0.5e0) >= 127.5e0 THEN 255 ELSE 0 END"
    _spark = _rule.format(f"element_at(array({_flat}), {_place})")
    add(f"dither_{_name}", lambda s, d, e=_spark: tables.gray(s, d).selectExpr("image_id", "y", "x", f"{e} AS l"), f"WITH {GRAY_SQL} SELECT {AT}, {_rule.format(f'([{_flat}])[{_place}]')} AS l FROM gray")
