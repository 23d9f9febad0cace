"""Aggregates over images, boxes, vectors, requests and measurements, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterfold.functions.numbers import byte
from rasterfold.operators import analytics, pixels, thresholds
from rasterfold.plans.imaging import AT, HEIGHT, WIDTH, Query
from rasterfold.sources import tables
from rasterfold.sources.tables import BOXES_SQL, GRAY_SQL, INK_SQL, PAIR_SQL, RGBA_SQL

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# Histograms and what follows from them.
add("histogram", lambda s, d: thresholds.histogram(tables.gray(s, d)), f"WITH {GRAY_SQL} SELECT image_id, l AS level, count(*) AS n FROM gray GROUP BY 1, 2")
add(
    "percentiles",
    lambda s, d: analytics.percentiles(tables.gray(s, d), (1, 50, 99)),
    f"WITH {GRAY_SQL}, c AS (SELECT image_id, l, sum(count(*)) OVER (PARTITION BY image_id ORDER BY l) AS upto, sum(count(*)) OVER (PARTITION BY image_id) AS w FROM gray GROUP BY 1, 2) SELECT image_id, "
    + ", ".join(f"min(l) FILTER (upto * 100 >= w * {p}) AS p{p}" for p in (1, 50, 99))
    + " FROM c GROUP BY 1",
)
_BOUNDS = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in "rgb")
_STRETCHED = ", ".join(f"CASE WHEN hi_{c} = lo_{c} THEN {c} ELSE {byte(f'({c} - lo_{c}) * 255e0 / (hi_{c} - lo_{c})')} END AS {c}" for c in "rgb")
add("normalize", lambda s, d: analytics.joined_to_own(tables.rgba(s, d), _BOUNDS).selectExpr("image_id", "y", "x", *_split(_STRETCHED), "a"), f"WITH {RGBA_SQL}, t AS (SELECT image_id, {_BOUNDS} FROM px GROUP BY 1) SELECT {AT}, {_STRETCHED}, a FROM px JOIN t USING (image_id)")


def _split(columns: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


_CLIPPED = "count(*) AS pixels, avg(l) AS mean_luma, sum(CASE WHEN l = 0 THEN 1 ELSE 0 END) AS dark, sum(CASE WHEN l = 255 THEN 1 ELSE 0 END) AS bright, min(l) AS lowest, max(l) AS highest"
add("measure_exposure", lambda s, d: tables.gray(s, d).groupBy("image_id").agg(*(F.expr(c) for c in _split(_CLIPPED))).withColumn("mean_luma", F.round("mean_luma", 6)), f"WITH {GRAY_SQL} SELECT image_id, pixels, round(mean_luma, 6) AS mean_luma, CAST(dark AS BIGINT) AS dark, CAST(bright AS BIGINT) AS bright, lowest, highest FROM (SELECT image_id, {_CLIPPED} FROM gray GROUP BY 1)")
add(
    "equalize_global",
    lambda s, d: analytics.equalize(tables.gray(s, d)),
    f"""WITH {GRAY_SQL}, c AS (SELECT image_id, l, sum(count(*)) OVER (PARTITION BY image_id ORDER BY l) AS upto, sum(count(*)) OVER (PARTITION BY image_id) AS w FROM gray GROUP BY 1, 2),
m AS (SELECT *, min(upto) OVER (PARTITION BY image_id) AS least_upto FROM c)
SELECT {AT}, CASE WHEN w = least_upto THEN l ELSE CAST(floor((upto - least_upto) * 255e0 / (w - least_upto) + 0.5e0) AS INT) END AS l FROM gray JOIN m USING (image_id, l)""",
)
add(
    "equalize_tiles",
    lambda s, d: analytics.equalize(pixels.sized(tables.gray(s, d)), "y * 4 div height * 8 + x * 8 div width"),
    f"""WITH {GRAY_SQL}, s AS (SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width FROM gray GROUP BY 1), g AS (SELECT *, y * 4 // height * 8 + x * 8 // width AS tile FROM gray JOIN s USING (image_id)), c AS (SELECT image_id, tile, l, sum(count(*)) OVER (PARTITION BY image_id, tile ORDER BY l) AS upto, sum(count(*)) OVER (PARTITION BY image_id, tile) AS w FROM g GROUP BY 1, 2, 3),
m AS (SELECT *, min(upto) OVER (PARTITION BY image_id, tile) AS least_upto FROM c)
SELECT {AT}, CASE WHEN w = least_upto THEN l ELSE CAST(floor((upto - least_upto) * 255e0 / (w - least_upto) + 0.5e0) AS INT) END AS l FROM g JOIN m USING (image_id, tile, l)""",
)
add("distinct_colors", lambda s, d: tables.rgba(s, d).groupBy("image_id").agg(F.countDistinct("r", "g", "b", "a").alias("colors")), f"WITH {RGBA_SQL} SELECT image_id, count(DISTINCT (r, g, b, a)) AS colors FROM px GROUP BY 1")
_BIN = "(r div 8) * 1024 + (g div 8) * 32 + b div 8"
add(
    "dominant_bins",
    lambda s, d: tables.rgba(s, d).groupBy("image_id", F.expr(_BIN).alias("bin")).agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("n"), "bin"))).where("rank <= 5"),
    f"WITH {RGBA_SQL}, b AS (SELECT image_id, CAST({_BIN.replace('div', '//')} AS BIGINT) AS bin, count(*) AS n FROM px GROUP BY 1, 2) SELECT image_id, bin, n, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bin) AS INT) AS rank FROM b QUALIFY rank <= 5",
)

# Pairs of images.
_PSNR = "round(CASE WHEN avg(power(l - l2, 2)) = 0 THEN NULL ELSE 10e0 * log10(65025e0 / avg(power(l - l2, 2))) END, 6)"
add("psnr", lambda s, d: tables.pair(s, d).groupBy("image_id").agg(F.expr(_PSNR).alias("psnr")), f"WITH {PAIR_SQL} SELECT image_id, {_PSNR} AS psnr FROM pair GROUP BY 1")
_SUMS = "avg(l) AS ma, avg(l2) AS mb, avg(l * l) AS qa, avg(l2 * l2) AS qb, avg(l * l2) AS ab"
_SSIM = "((2 * ma * mb + 6.5025e0) * (2 * (ab - ma * mb) + 58.5225e0)) / ((ma * ma + mb * mb + 6.5025e0) * (qa - ma * ma + qb - mb * mb + 58.5225e0))"
add(
    "ssim_blocks",
    lambda s, d: tables.pair(s, d).groupBy("image_id", F.expr("y div 8").alias("by"), F.expr("x div 8").alias("bx")).agg(*(F.expr(c) for c in _split(_SUMS))).groupBy("image_id").agg(F.round(F.avg(F.expr(_SSIM)), 6).alias("ssim")),
    f"WITH {PAIR_SQL}, b AS (SELECT image_id, y // 8, x // 8, {_SUMS} FROM pair GROUP BY 1, 2, 3) SELECT image_id, round(avg({_SSIM}), 6) AS ssim FROM b GROUP BY 1",
)
_LAPLACIAN = "lag(l) OVER (PARTITION BY image_id, y ORDER BY x) + lead(l) OVER (PARTITION BY image_id, y ORDER BY x) + lag(l) OVER (PARTITION BY image_id, x ORDER BY y) + lead(l) OVER (PARTITION BY image_id, x ORDER BY y) - 4 * l"
add(
    "measure_sharpness",
    lambda s, d: tables.gray(s, d).selectExpr("image_id", f"{_LAPLACIAN} AS v").groupBy("image_id").agg(F.round(F.var_pop("v"), 6).alias("laplacian_variance")),
    f"WITH {GRAY_SQL}, v AS (SELECT image_id, {_LAPLACIAN} AS v FROM gray) SELECT image_id, round(var_pop(v), 6) AS laplacian_variance FROM v GROUP BY 1",
)
add(
    "perceptual_hash",
    lambda s, d: analytics.difference_hash(tables.gray(s, d)),
    f"""WITH {GRAY_SQL}, c AS (SELECT image_id, y * 8 // {HEIGHT} AS v, x * 9 // {WIDTH} AS u, avg(l) AS m FROM gray GROUP BY 1, 2, 3),
b AS (SELECT image_id, v, u, m > lead(m) OVER (PARTITION BY image_id, v ORDER BY u) AS bit FROM c)
SELECT image_id, CAST(sum(CASE WHEN NOT bit OR u >= 8 THEN 0 WHEN v * 8 + u = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << CAST(v * 8 + u AS INT) END) AS BIGINT) AS hash, CAST(count(*) FILTER (bit AND u < 8) AS BIGINT) AS ones FROM b GROUP BY 1""",
)
# Document pages.
add("row_profile", lambda s, d: tables.ink(s, d).groupBy("image_id", "y").agg(F.sum("ink").alias("ink")), f"WITH {INK_SQL} SELECT image_id, y, CAST(sum(ink) AS BIGINT) AS ink FROM ink GROUP BY 1, 2")
add("column_profile", lambda s, d: tables.ink(s, d).groupBy("image_id", "x").agg(F.sum("ink").alias("ink")), f"WITH {INK_SQL} SELECT image_id, x, CAST(sum(ink) AS BIGINT) AS ink FROM ink GROUP BY 1, 2")
add("ink_bounds", lambda s, d: tables.ink(s, d).where("ink = 1").groupBy("image_id").agg(F.count("*").alias("area"), F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom")), f'WITH {INK_SQL} SELECT image_id, count(*) AS area, min(x) AS "left", max(x) AS "right", min(y) AS top, max(y) AS bottom FROM ink WHERE ink = 1 GROUP BY 1')
add(
    "ink_runs",
    lambda s, d: analytics.runs(tables.ink(s, d)),
    f"WITH {INK_SQL}, n AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM ink WHERE ink = 1) SELECT image_id, y, CAST(min(x) AS INT) AS x, count(*) AS length FROM n GROUP BY image_id, y, g",
)

# Boxes.
_IOU = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
add(
    "box_overlap",
    lambda s, d: (lambda b: b.alias("a").join(b.alias("b"), F.expr("a.img = b.img AND a.box < b.box AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")).selectExpr("a.img AS img", "a.box AS box", "b.box AS other", f"round({_IOU} * 1e0 / (a.w * a.h + b.w * b.h - {_IOU}), 9) AS iou"))(tables.boxes(s, d)),
    f"WITH {BOXES_SQL} SELECT a.img, a.box, b.box AS other, round({_IOU} * 1e0 / (a.w * a.h + b.w * b.h - {_IOU}), 9) AS iou FROM boxes a JOIN boxes b ON a.img = b.img AND a.box < b.box AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h",
)
_RECT = "least(x + w, 150) - greatest(x, 50) AS iw, least(y + h, 80) - greatest(y, 20) AS ih, x - 2 AS inflated_x, w + 4 AS inflated_w, least(x, 50) AS union_x, greatest(x + w, 150) - least(x, 50) AS union_w, x <= 100 AND 100 < x + w AND y <= 50 AND 50 < y + h AS holds_point"
add("rectangle_maths", lambda s, d: tables.boxes(s, d).selectExpr("img", "box", *_split(_RECT)), f"WITH {BOXES_SQL} SELECT img, box, {_RECT} FROM boxes")
add("suppress_overlaps", lambda s, d: analytics.suppress(tables.boxes(s, d).withColumn("score", F.expr("(w * 7 + h * 3) % 101 / 101D"))))

# Frames of an animation: the images of a table in order.
_FRAMES = "SELECT image_id AS frame, count(*) AS pixels, CAST(sum(l) AS BIGINT) AS total FROM gray GROUP BY 1"
_frames = lambda s, d: tables.gray(s, d).groupBy(F.col("image_id").alias("frame")).agg(F.count("*").alias("pixels"), F.sum("l").alias("total"))
for _name, _shift, _keep in (("frame_remove", "CASE WHEN frame > 3 THEN frame - 1 ELSE frame END", "frame <> 3"), ("frame_insert", "CASE WHEN frame >= 2 THEN frame + 1 ELSE frame END", "true"), ("frame_move", "CASE WHEN frame = 5 THEN 1 WHEN frame >= 1 AND frame < 5 THEN frame + 1 ELSE frame END", "true")):
    add(_name, lambda s, d, e=_shift, k=_keep: _frames(s, d).where(k).selectExpr(f"{e} AS frame", "pixels", "total"), f"WITH {GRAY_SQL}, f AS ({_FRAMES}) SELECT {_shift} AS frame, pixels, total FROM f WHERE {_keep}")
add("frame_root", lambda s, d: tables.gray(s, d).join(tables.gray(s, d).agg(F.min("image_id").alias("first")), F.expr("image_id = first")).select("image_id", "y", "x", "l"), f"WITH {GRAY_SQL} SELECT {AT}, l FROM gray WHERE image_id = (SELECT min(image_id) FROM gray)")

# Vectors.
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_sdot = "aggregate(zip_with({0}, {1}, (p, q) -> CAST(p AS DOUBLE) * CAST(q AS DOUBLE)), 0D, (s, v) -> s + v)"
add(
    "cosine_similarity",
    lambda s, d: (lambda e: e.alias("a").join(e.alias("b"), F.expr("a.vec_id + 1 = b.vec_id")).selectExpr("a.vec_id AS vec_id", f"round({_sdot.format('a.embedding', 'b.embedding')} / sqrt({_sdot.format('a.embedding', 'a.embedding')} * {_sdot.format('b.embedding', 'b.embedding')}), 6) AS cosine"))(tables.table(s, d, "embeddings")),
    f"SELECT a.vec_id, round({_DOT.format('a.embedding', 'b.embedding')} / sqrt({_DOT.format('a.embedding', 'a.embedding')} * {_DOT.format('b.embedding', 'b.embedding')}), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id",
)
add(
    "vector_normalize",
    lambda s, d: tables.table(s, d, "embeddings").withColumn("n", F.expr(f"sqrt({_sdot.format('embedding', 'embedding')})")).select("vec_id", F.posexplode(F.expr("transform(embedding, v -> round(v / n, 6))")).alias("i", "v")),
    f"SELECT vec_id, CAST(i - 1 AS INT) AS i, round(e / n, 6) AS v FROM (SELECT vec_id, sqrt({_DOT.format('embedding', 'embedding')}) AS n, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)",
)
add(
    "softmax",
    lambda s, d: tables.table(s, d, "embeddings").selectExpr("vec_id", "transform(embedding, v -> exp(CAST(v AS DOUBLE) - array_max(embedding))) AS e").withColumn("total", F.expr("aggregate(e, 0D, (s, v) -> s + v)")).select("vec_id", F.posexplode(F.expr("transform(e, v -> round(v / total, 6))")).alias("i", "p")),
    "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, exp(unnest(embedding)::DOUBLE - list_max(embedding)) AS e FROM embeddings) SELECT vec_id, CAST(i - 1 AS INT) AS i, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e",
)
add(
    "embedding_mean",
    lambda s, d: tables.table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "e")).groupBy("label", "i").agg(F.round(F.avg(F.col("e").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("e").cast("double")), 6).alias("std")),
    "WITH e AS (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings) SELECT label, i, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std FROM e GROUP BY 1, 2",
)
# Every four components are the scores of one picture for four directions.
add(
    "orientation_argmax",
    lambda s, d: tables.table(s, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.expr("CAST(size(embedding) div 4 - 1 AS INT)"))).alias("picture"), "embedding").selectExpr("vec_id", "picture", "slice(embedding, picture * 4 + 1, 4) AS p").selectExpr("vec_id", "picture", "CAST((array_position(p, array_max(p)) - 1) * 90 AS INT) AS degrees"),
    "WITH e AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, CAST(i // 4 AS INT) AS picture, CAST(arg_min(i % 4, (-e, i)) * 90 AS INT) AS degrees FROM e GROUP BY 1, 2",
)

# Text recognition metrics, over names as references.
_REF, _HYP = "p_name AS ref", "replace(p_name, 'e', '') AS hyp"
_CER = "sum(levenshtein(ref, hyp)) AS edits, sum(length(ref)) AS characters, sum(CASE WHEN ref = hyp THEN 1 ELSE 0 END) AS exact"
add(
    "character_errors",
    lambda s, d: analytics.grouped_errors(tables.table(s, d, "part").selectExpr("p_brand AS category", "p_type AS script", _REF, _HYP)),
    f"""WITH e AS (SELECT p_brand AS category, p_type AS script, {_REF}, {_HYP} FROM part)
SELECT category, script, CAST(grouping(category, script) AS BIGINT) AS level, CAST(edits AS BIGINT) AS edits, CAST(characters AS BIGINT) AS characters, CAST(exact AS BIGINT) AS exact, round(edits / CAST(characters AS DOUBLE), 9) AS cer
FROM (SELECT category, script, {_CER}, grouping(category, script) FROM e GROUP BY GROUPING SETS ((), (category), (script))) t(category, script, edits, characters, exact, g)""".replace("CAST(grouping(category, script) AS BIGINT) AS level", "CAST(g AS BIGINT) AS level"),
)
add(
    "corpus_coverage",
    lambda s, d: analytics.coverage(tables.table(s, d, "documents").select("doc_id"), tables.table(s, d, "labels").select("doc_id"), "doc_id"),
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' WHEN a.n > 1 OR b.n > 1 THEN 'duplicate' ELSE 'matched' END AS state FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) b ON a.doc_id = b.doc_id",
)

# Telemetry.
add(
    "telemetry_daily",
    lambda s, d: analytics.telemetry(tables.table(s, d, "events")),
    "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type AS op, count(*) AS calls, round(sum(value), 4) AS total, max(value) AS longest, CAST(sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) AS BIGINT) AS fast FROM events GROUP BY 1, 2",
)
add(
    "latency_percentiles",
    lambda s, d: analytics.value_percentiles(tables.table(s, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}),
    "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
)

# Requests.
add(
    "request_canonical",
    lambda s, d: analytics.requests(tables.table(s, d, "pages")),
    """WITH r AS (SELECT page_id, lower(url) || '?width=' || (page_id % 800 + 1) || '&mode=' || CASE page_id % 3 WHEN 0 THEN 'max' WHEN 1 THEN 'crop' ELSE 'pad' END || '&height=' || (page_id % 600 + 1) AS url FROM pages),
c AS (SELECT page_id, split_part(url, '?', 1) AS path, list_sort(string_split(split_part(url, '?', 2), '&')) AS parts FROM r)
SELECT page_id, path || '?' || array_to_string(parts, '&') AS canonical, sha256(path || '?' || array_to_string(parts, '&')) AS cache_key, CAST(len(parts) AS INT) AS commands FROM c""",
)
add("connected_components", lambda s, d: analytics.label_components(tables.ink(s, d)))
add("component_statistics", lambda s, d: analytics.label_components(tables.ink(s, d)).groupBy("image_id", "label").agg(F.count("*").alias("area"), F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom")))
