"""Pages of ink, tensors, tables of colours and colour spaces both ways, each with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterfold.functions import color, kernels
from rasterfold.functions.numbers import byte, luma, num
from rasterfold.operators import analytics, geometry, luts, pages, tensors
from rasterfold.plans.imaging import AT, HEIGHT, WIDTH, Query, _taps_sql
from rasterfold.sources import tables
from rasterfold.sources.tables import GRAY_SQL, RGBA_SQL

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: What is darker than this is ink.
DARK = 120
PAGE_SQL = GRAY_SQL + f", page AS (SELECT image_id, y, x, CASE WHEN l < {DARK} THEN 1 ELSE 0 END AS ink FROM gray)"


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def page(s: SparkSession, d: str) -> DataFrame:
    """The images as pages of ink and paper."""
    return tables.gray(s, d).selectExpr("image_id", "y", "x", f"CASE WHEN l < {DARK} THEN 1 ELSE 0 END AS ink")


# Clean-up by components; SQL has none, tests hold them against flood fills.
add("fill_holes", lambda s, d: pages.fill_holes(page(s, d)))
add("despeckle", lambda s, d: pages.despeckle(page(s, d), 3))
add("remove_borders", lambda s, d: pages.remove_borders(page(s, d)))
add("thin", lambda s, d: pages.thin(page(s, d)))

_SIZE = "s AS (SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width FROM page GROUP BY 1)"
add("remove_lines", lambda s, d: pages.remove_lines(page(s, d), 4), f"""WITH {PAGE_SQL},
n AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM page WHERE ink = 1),
r AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY image_id, y, g) >= 4 THEN 1 ELSE 0 END AS rule FROM n),
c AS (SELECT *, coalesce(min(rule) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), 1) = 0 AS above, coalesce(min(rule) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 1) = 0 AS below FROM r),
b AS (SELECT *, y - row_number() OVER (PARTITION BY image_id, x ORDER BY y) AS band FROM c WHERE rule = 1),
e AS (SELECT image_id, y, x FROM b QUALIFY NOT (arg_min(above, y) OVER (PARTITION BY image_id, x, band) AND arg_max(below, y) OVER (PARTITION BY image_id, x, band)))
SELECT {AT}, CASE WHEN e.image_id IS NOT NULL THEN 0 ELSE ink END AS ink FROM page LEFT JOIN e USING (image_id, y, x)""")

add("dark_margins", lambda s, d: pages.dark_margins(page(s, d), 0.3), f"""WITH {PAGE_SQL}, {_SIZE},
c AS (SELECT image_id, x, sum(ink) AS n FROM page GROUP BY 1, 2),
h AS (SELECT image_id, height, width, min(x) FILTER (n < 0.3e0 * height) AS first_x, max(x) FILTER (n < 0.3e0 * height) AS last_x FROM c JOIN s USING (image_id) GROUP BY 1, 2, 3),
i AS (SELECT image_id, height, CAST(least(floor(width * 0.15e0), coalesce(first_x, width)) AS INT) AS "left", CAST(greatest(width - greatest(floor(width * 0.15e0) - 1, 0), coalesce(last_x, -1) + 1) AS INT) AS "right" FROM h),
l AS (SELECT image_id, i.height, i."left", i."right", y, sum(ink) AS n FROM page JOIN i USING (image_id) WHERE x >= i."left" AND x < i."right" GROUP BY 1, 2, 3, 4, 5),
v AS (SELECT image_id, height, "left", "right", min(y) FILTER (n < 0.3e0 * ("right" - "left")) AS first_y, max(y) FILTER (n < 0.3e0 * ("right" - "left")) AS last_y FROM l GROUP BY 1, 2, 3, 4)
SELECT image_id, "left", CAST(least(floor(height * 0.15e0), coalesce(first_y, height)) AS INT) AS top, "right", CAST(greatest(height - greatest(floor(height * 0.15e0) - 1, 0), coalesce(last_y, -1) + 1) AS INT) AS bottom FROM v""")

_LINE = "floor(round(y * cos(radians(step / 100e0)) - x * sin(radians(step / 100e0)), 6) + 0.5e0)"
_ENERGY = "{0} AS (SELECT image_id, step, sum(n * n) AS energy FROM (SELECT image_id, step, " + _LINE + " AS line, count(*) AS n FROM ({1}) GROUP BY 1, 2, 3) GROUP BY 1, 2)"
_BEST = "{0} AS (SELECT image_id, step, energy FROM {1} QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY energy DESC, abs(step), step) = 1)"
_SKEW = f"""WITH {PAGE_SQL}, p AS (SELECT image_id, y, x FROM (SELECT *, coalesce(lead(ink) OVER (PARTITION BY image_id, x ORDER BY y), 0) AS below FROM page) WHERE ink = 1 AND below = 0),
{_ENERGY.format('e1', 'SELECT p.*, step FROM p, generate_series(-1500, 1500, 50) u(step)')}, {_BEST.format('b1', 'e1')},
{_ENERGY.format('e2', 'SELECT p.*, b1.step + u.o AS step FROM p JOIN b1 USING (image_id), generate_series(-60, 60, 5) u(o)')}, {_BEST.format('b2', 'e2')}"""
add("detect_skew", lambda s, d: pages.skew(page(s, d)), f"{_SKEW} SELECT image_id, step / 100e0 AS degrees, CAST(energy AS BIGINT) AS energy FROM b2")
_MX, _MY = "(width - 1) / 2e0", "(height - 1) / 2e0"
_COS, _SIN = "cos(radians(step / 100e0))", "sin(radians(step / 100e0))"
add("deskew", lambda s, d: pages.deskew(page(s, d), pages.skew(page(s, d))), f"""{_SKEW}, {_SIZE},
a AS (SELECT image_id, y, x, CAST(floor(round({_MY} + (x - {_MX}) * {_SIN} + (y - {_MY}) * {_COS}, 6) + 0.5e0) AS INT) AS v, CAST(floor(round({_MX} + (x - {_MX}) * {_COS} - (y - {_MY}) * {_SIN}, 6) + 0.5e0) AS INT) AS u FROM page JOIN s USING (image_id) JOIN b2 USING (image_id))
SELECT a.image_id, a.y, a.x, coalesce(q.ink, 0) AS ink FROM a LEFT JOIN page q ON q.image_id = a.image_id AND q.y = a.v AND q.x = a.u""")

# Equalisation by clipped tiles, mappings blended.
_TY, _TX, _CLIP = 3, 5, 4


def _axis_sql(name: str, side: str, tiles: int) -> str:
    """n, at, t, w: the tiles whose middles are nearest to each place along an axis of n pixels."""
    return f"""{name}m AS (SELECT n, t, ((t * n // least({tiles}, n)) + ((t + 1) * n // least({tiles}, n))) / 2e0 - 0.5e0 AS m FROM (SELECT DISTINCT {side} AS n FROM s), generate_series(0, {tiles - 1}) u(t) WHERE t < least({tiles}, n)),
{name}p AS (SELECT n, u.p AS at FROM (SELECT DISTINCT {side} AS n FROM s), generate_series(0, 4095) u(p) WHERE u.p < n),
{name}l AS (SELECT p.n, p.at, coalesce(max(m.t) FILTER (m.m <= p.at), -1) AS lo, max(m.t) AS last FROM {name}p p JOIN {name}m m USING (n) GROUP BY 1, 2),
{name} AS (SELECT l.n, l.at, greatest(0, lo) AS t, CASE WHEN lo < 0 OR lo >= last THEN 1e0 ELSE 1 - (l.at - a.m) / (b.m - a.m) END AS w FROM {name}l l LEFT JOIN {name}m a ON a.n = l.n AND a.t = lo LEFT JOIN {name}m b ON b.n = l.n AND b.t = lo + 1
  UNION ALL SELECT l.n, l.at, lo + 1, (l.at - a.m) / (b.m - a.m) FROM {name}l l JOIN {name}m a ON a.n = l.n AND a.t = lo JOIN {name}m b ON b.n = l.n AND b.t = lo + 1 WHERE lo >= 0 AND lo < last)"""


add("equalize_adaptive", lambda s, d: pages.equalize_adaptive(tables.gray(s, d), _TY, _TX, _CLIP), f"""WITH {GRAY_SQL}, s AS (SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width FROM gray GROUP BY 1),
c AS (SELECT image_id, ((y + 1) * least({_TY}, height) - 1) // height AS v, ((x + 1) * least({_TX}, width) - 1) // width AS u, l, count(*) AS n FROM gray JOIN s USING (image_id) GROUP BY 1, 2, 3, 4),
f AS (SELECT image_id, v, u, l, coalesce(n, 0) AS n FROM (SELECT image_id, v, u, g.l FROM (SELECT DISTINCT image_id, v, u FROM c), generate_series(0, 255) g(l)) g LEFT JOIN c USING (image_id, v, u, l)),
o AS (SELECT *, sum(greatest(0, n - {_CLIP})) OVER (PARTITION BY image_id, v, u) AS over FROM f),
k AS (SELECT image_id, v, u, l, least(n, {_CLIP}) + over // 256 + CASE WHEN l < over % 256 THEN 1 ELSE 0 END AS n FROM o),
t AS (SELECT *, sum(n) OVER (PARTITION BY image_id, v, u ORDER BY l) AS upto, sum(n) OVER (PARTITION BY image_id, v, u) AS whole FROM k),
b AS (SELECT *, min(upto) FILTER (upto > 0) OVER (PARTITION BY image_id, v, u) AS least_upto FROM t),
lut AS (SELECT image_id, v, u, l, CASE WHEN whole = least_upto THEN CAST(l AS DOUBLE) ELSE greatest(0e0, (upto - least_upto) * 255e0 / (whole - least_upto)) END AS m FROM b),
{_axis_sql('ay', 'height', _TY)}, {_axis_sql('ax', 'width', _TX)}
SELECT image_id, y, x, {byte('round(sum(ay.w * ax.w * m), 6)')} AS l FROM gray JOIN s USING (image_id) JOIN lut USING (image_id, l) JOIN ay ON ay.n = height AND ay.at = y AND ay.t = lut.v JOIN ax ON ax.n = width AND ax.at = x AND ax.t = lut.u GROUP BY 1, 2, 3""")

# Tensors, back and forth.
_MEAN, _STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
add("from_tensor", lambda s, d: tensors.from_tensor(tensors.to_tensor(tables.rgba(s, d), mean=_MEAN, std=_STD), mean=_MEAN, std=_STD), f"WITH {RGBA_SQL} SELECT {AT}, r, g, b FROM px")
add("from_tensor_hwc", lambda s, d: tensors.from_tensor(tensors.to_tensor(tables.rgba(s, d), "hwc", tuple("bgr")), "hwc", tuple("bgr")), f"WITH {RGBA_SQL} SELECT {AT}, b, g, r FROM px")
add(
    "tensor_gray",
    lambda s, d: tensors.to_tensor(tables.rgba(s, d).selectExpr("image_id", "y", "x", f"{luma()} AS l"), channels=("l",), mean=(0.5,), std=(0.25,)).select("image_id", "height", "width", F.posexplode("tensor").alias("i", "v")).withColumn("v", F.round("v", 6)),
    f"WITH {RGBA_SQL}, s AS (SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width FROM px GROUP BY 1) SELECT image_id, height, width, y * width + x AS i, round(({luma()} / 255e0 - 0.5e0) / 0.25e0, 6) AS v FROM px JOIN s USING (image_id)",
)
add(
    "resize_to_tensor",
    lambda s, d: tensors.resize_to_tensor(tables.gray(s, d), 20, 6, "triangle", ("l",)).select("image_id", F.posexplode("tensor").alias("i", "v")).withColumn("v", F.round("v", 6)),
    f"WITH {GRAY_SQL}, hs AS (SELECT image_id, max(y) + 1 AS n FROM gray GROUP BY 1), {_taps_sql('dn', 'SELECT DISTINCT n FROM hs', 6, 'triangle')}, {_taps_sql('ac', f'SELECT {WIDTH} AS n', 20, 'triangle')} SELECT image_id, CAST(dn.t * 20 + ac.t AS INT) AS i, round({byte('round(sum(l * dn.w * ac.w), 6)')} / 255e0, 6) AS v FROM gray JOIN hs USING (image_id) JOIN dn ON dn.n = hs.n AND dn.s = y JOIN ac ON ac.s = x GROUP BY 1, dn.t, ac.t",
)
# Coordinates of a tensor place in the image that was resized to it.
_MAPPING = [f"round((tx + 0.5e0) * {WIDTH} / 20 - 0.5e0, 6) AS sx", f"round((ty + 0.5e0) * {HEIGHT} / 6 - 0.5e0, 6) AS sy"]
add("tensor_mapping", lambda s, d: geometry.blank(tables.gray(s, d), 20, 6).selectExpr("image_id", "y AS ty", "x AS tx", *_MAPPING), f"WITH {GRAY_SQL} SELECT i.image_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx, {', '.join(_MAPPING)} FROM (SELECT DISTINCT image_id FROM gray) i, generate_series(0, 5) a(ty), generate_series(0, 19) b(tx)")

# Tables of colours: a file's text, read and applied; the SQL weighs all entries of the lattice.
_RULE = {"r": (0.0, 0.4, 0.0, 0.1), "g": (0.0, 0.05, 0.45, 0.0), "b": (1.0, 0.0, 0.0, -0.5)}
_ENTRIES = {(i, j, k): [w[0] + w[1] * i + w[2] * j + w[3] * k + 0.05 * (i * j * k % 3) for w in _RULE.values()] for k in range(3) for j in range(3) for i in range(3)}
CUBE = "\n".join(['TITLE "rule"', "LUT_3D_SIZE 3", *(" ".join(f"{v:.6f}" for v in e) for e in _ENTRIES.values())])
_LATTICE = {c: " + ".join(f"{num(round(e[n], 6))} * " + " * ".join(f"greatest(0e0, 1 - abs({v} * 2 / 255e0 - {a}))" for v, a in zip("rgb", at, strict=True)) for at, e in _ENTRIES.items()) for n, c in enumerate("rgb")}
_shown = lambda e: f"CAST(floor(round(least(1e0, greatest(0e0, {e})) * 255, 6) + 0.5e0) AS INT)"
add("lut_3d", lambda s, d: luts.apply(tables.rgba(s, d), luts.parse_cube(CUBE)), f"WITH {RGBA_SQL} SELECT {AT}, {', '.join(f'{_shown(e)} AS {c}' for c, e in _LATTICE.items())}, a FROM px")
add("lut_identity", lambda s, d: luts.apply(tables.rgba(s, d), luts.parse_cube(luts.identity_cube(9)), "tetrahedral"), f"WITH {RGBA_SQL} SELECT {AT}, r, g, b, a FROM px")
_CURVE = [round((i / 16) ** 1.5 * 0.9 + 0.05, 6) for i in range(17)]
_at = lambda c: f"least(15, CAST(floor({c} * 16 / 255e0) AS INT))"
_curve = lambda c: f"([{', '.join(map(num, _CURVE))}])[{_at(c)} + 1] * (1 - ({c} * 16 / 255e0 - {_at(c)})) + ([{', '.join(map(num, _CURVE))}])[{_at(c)} + 2] * ({c} * 16 / 255e0 - {_at(c)})"
add("lut_1d", lambda s, d: luts.apply(tables.rgba(s, d), luts.parse_cube("\n".join(["LUT_1D_SIZE 17", *(f"{v} {v} {v}" for v in _CURVE)]))), f"WITH {RGBA_SQL} SELECT {AT}, {', '.join(f'{_shown(_curve(c))} AS {c}' for c in 'rgb')}, a FROM px")

# Colour spaces there and back: what returns is the pixel.
_there = {
    "xyz": ({f"cie_{k.lower()}": e for k, e in color.xyz().items()}, [color.from_xyz()]), "lab": (color.lab(), [color.lab_to_xyz(), color.from_xyz()]), "lch": (color.lch(), [color.lch_to_lab(), color.lab_to_xyz(), color.from_xyz()]),
    "oklab": (color.oklab(), [color.from_oklab()]), "hsv": (color.hsv(), [color.from_hsv()]), "hsl": (color.hsl(), [color.from_hsl()]), "linear": ({f"lin_{c}": color.linear(c) for c in "rgb"}, [color.from_linear("lin_r", "lin_g", "lin_b")]),
    "d50": ({f"cie_{k.lower()}": e for k, e in color.xyz().items()}, [color.adapted(), color.adapted(False), color.from_xyz()]),
}
for _name, (_out, _back) in _there.items():

    def _round_trip(s: SparkSession, d: str, out=_out, back=_back) -> DataFrame:
        px = tables.rgba(s, d).selectExpr("image_id", "y", "x", *(f"{e} AS {c}" for c, e in out.items()))
        for step in back:
            px = px.selectExpr("image_id", "y", "x", *(f"{e} AS {c}" for c, e in step.items()))
        return px

    add(f"color_back_{_name}", _round_trip, f"WITH {RGBA_SQL} SELECT {AT}, r, g, b FROM px")

# Recognition and detection.
_HYP = "replace(replace(p_name, 'e', ''), ' s', ' ')"
add("word_errors", lambda s, d: analytics.word_errors(tables.table(s, d, "part").selectExpr("p_brand AS category", "p_name AS ref", f"{_HYP} AS hyp")))


def _detections(s: SparkSession, d: str) -> DataFrame:
    boxes = tables.boxes(s, d)
    moved = boxes.where("(img + box) % 5 <> 0").selectExpr("img", "box", "x + box % 3 AS x", "y", "w", "h")
    more = boxes.where("(img + box) % 7 = 0").selectExpr("img", "box + 100 AS box", "x + 1 AS x", "y + 1 AS y", "w", "h")
    return analytics.match_boxes(boxes, moved.unionByName(more))


add("detection_matches", _detections)
add("detection_scores", lambda s, d: analytics.detection_scores(_detections(s, d)))

# Error diffusion goes pixel by pixel; tests hold it against a plain scan.
for _name, (_divisor, _weights) in kernels.DIFFUSIONS.items():
    add(f"dither_{_name}", lambda s, d, k=_divisor, w=_weights: analytics.diffuse(tables.gray(s, d), k, w))
