"""Images, boxes, requests and measurements derived from plain tables, as relations of pixels.

An image is a set of rows (image_id, y, x, channels). Each function has its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEIGHT, WIDTH = 16, 64

GRAY_SQL = f"""gray AS (
  SELECT vec_id // {HEIGHT} AS image_id, CAST(vec_id % {HEIGHT} AS INT) AS y, CAST(i - 1 AS INT) AS x,
         CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.5e0) * 255))) AS INT) AS l
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"""
RGBA_SQL = (
    GRAY_SQL
    + """, px AS (
  SELECT image_id, y, x, l AS r, (l * 7 + x * 3) % 256 AS g, (l * 13 + y * 5) % 256 AS b,
         CASE WHEN (x + y) % 7 = 0 THEN 128 ELSE 255 END AS a FROM gray)"""
)
PAIR_SQL = (
    GRAY_SQL
    + """, pair AS (
  SELECT image_id, y, x, l, CAST(least(255, greatest(0, l + ((x * 31 + y * 17) % 11) - 5)) AS INT) AS l2 FROM gray)"""
)
INK_SQL = """ink AS (
  SELECT doc_id AS image_id, CAST((i - 1) // 64 AS INT) AS y, CAST((i - 1) % 64 AS INT) AS x,
         CASE WHEN c IN (' ', chr(9), chr(10)) THEN 0 ELSE 1 END AS ink
  FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''))"""
BOXES_SQL = """boxes AS (
  SELECT l_orderkey AS img, l_linenumber AS box, CAST(l_partkey % 200 AS INT) AS x, CAST(l_suppkey % 100 AS INT) AS y,
         CAST(1 + l_quantity AS INT) AS w, CAST(1 + l_partkey % 37 AS INT) AS h FROM lineitem)"""


#: Side of the larger images that all components in a row make; the last one is what is left.
SHEET = 176
SHEET_SQL = f"""sheet AS (
  SELECT p // {SHEET * SHEET} AS image_id, CAST(p % {SHEET * SHEET} // {SHEET} AS INT) AS y, CAST(p % {SHEET} AS INT) AS x,
         CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.5e0) * 255))) AS INT) AS l
  FROM (SELECT vec_id * 64 + i - 1 AS p, e FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))),
sheet_pair AS (SELECT *, CAST(least(255, greatest(0, l + ((x * 31 + y * 17) % 11) - 5)) AS INT) AS l2 FROM sheet)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 vectors are the rows of an image, their components its pixels."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    level = F.expr("CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.5e0) * 255))) AS INT)")
    return rows.select(F.expr(f"vec_id div {HEIGHT}").alias("image_id"), F.expr(f"CAST(vec_id % {HEIGHT} AS INT)").alias("y"), "x", level.alias("l"))


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = gray(spark, sf_dir)
    return px.selectExpr("image_id", "y", "x", "l AS r", "(l * 7 + x * 3) % 256 AS g", "(l * 13 + y * 5) % 256 AS b", "CASE WHEN (x + y) % 7 = 0 THEN 128 ELSE 255 END AS a")


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray(spark, sf_dir).withColumn("l2", F.expr("CAST(least(255, greatest(0, l + ((x * 31 + y * 17) % 11) - 5)) AS INT)"))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components in a row as pixels of images of SHEET x SHEET, the last one lower, with a second level l2."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    level = F.expr("CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.5e0) * 255))) AS INT)")
    px = rows.select(F.expr("vec_id * 64 + i").alias("p"), level.alias("l"))
    px = px.selectExpr(f"p div {SHEET * SHEET} AS image_id", f"CAST(p % {SHEET * SHEET} div {SHEET} AS INT) AS y", f"CAST(p % {SHEET} AS INT) AS x", "l")
    return px.withColumn("l2", F.expr("CAST(least(255, greatest(0, l + ((x * 31 + y * 17) % 11) - 5)) AS INT)"))


#: Corners (x, y) of the bright page in the photo of supplier k, from the upper left one to the right.
PHOTO_CORNERS = (("6 + k % 5", "5 + k % 3"), ("41 - k % 4", "4 + k % 6"), ("42 - k % 3", "35 - k % 4"), ("5 + k % 4", "34 - k % 5"))
PHOTO_WIDTH, PHOTO_HEIGHT = 48, 40


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A photo of a bright page on a dark table for each supplier; the corners follow from its key, the grain from its balance."""
    keys = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS image_id", "s_suppkey AS k", "CAST(abs(s_acctbal) AS INT) AS grain")
    corners = keys.selectExpr("*", *(f"{e} AS c{a}{i}" for i, c in enumerate(PHOTO_CORNERS) for a, e in zip("xy", c, strict=True)))
    px = corners.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(PHOTO_HEIGHT - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(PHOTO_WIDTH - 1))))
    # Twice the coordinates, so that pixel middles are whole numbers.
    inside = " AND ".join(f"(2 * cx{j} - 2 * cx{i}) * (2 * y + 1 - 2 * cy{i}) - (2 * cy{j} - 2 * cy{i}) * (2 * x + 1 - 2 * cx{i}) >= 0" for i, j in ((0, 1), (1, 2), (2, 3), (3, 0)))
    return px.selectExpr("image_id", "y", "x", f"CASE WHEN {inside} THEN 200 ELSE 60 END + (x * 7 + y * 13 + grain) % 9 AS l").selectExpr("image_id", "y", "x", "CAST(l AS INT) AS l")


def _packed(value: str, n: int) -> str:
    """SQL for n bytes of a whole number in hexadecimal, in the byte order of the row (big)."""
    plain = f"lpad(hex(CAST({value} AS BIGINT)), {2 * n}, '0')"
    turned = "concat(" + ", ".join(f"substr({plain}, {2 * k + 1}, 2)" for k in range(n - 1, -1, -1)) + ")"
    return f"CASE WHEN big THEN {plain} ELSE {turned} END"


def exif_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, exif: a block of tags for each supplier, in either byte order, with its name, key and balance as values."""
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "rpad(s_name, 18, '.') AS name", "s_nationkey AS nation", "s_suppkey % 2 = 0 AS big")

    def entry(tag: int, kind: int, count: int, value: str, wide: int = 4) -> list[str]:
        """An entry; wide 2: two short values in place of one long one."""
        return [_packed(str(tag), 2), _packed(str(kind), 2), _packed(str(count), 4), *([_packed(value, 4)] if wide == 4 else [_packed(v, 2) for v in value.split(", ")])]

    # The standard's tags; places follow from the sizes of what stands before.
    parts = ["CASE WHEN big THEN '4D4D' ELSE '4949' END", _packed("42", 2), _packed("8", 4), _packed("7", 2)]
    parts += entry(256, 4, 1, "100 + k % 500") + entry(271, 2, 19, "98") + entry(274, 3, 1, "k % 8 + 1, 0", 2) + entry(282, 5, 1, "118") + entry(306, 2, 20, "126") + entry(34665, 4, 1, "146") + entry(34853, 4, 1, "184") + [_packed("0", 4)]
    parts += ["hex(encode(name, 'UTF-8'))", "'0000'", _packed("k * 10 + 1", 4), _packed("k % 7", 4), "hex(encode('2024:05:06 07:08:09', 'UTF-8'))", "'00'"]
    parts += [_packed("2", 2), *entry(33434, 10, 1, "176"), *entry(34855, 3, 2, "100 * (k % 9), nation", 2), _packed("0", 4), _packed("(4294967296 - k) % 4294967296", 4), _packed("8", 4)]
    parts += [_packed("2", 2), *entry(1, 7, 2, "CASE WHEN big THEN 1308622848 ELSE 77 END"), *entry(2, 5, 3, "214"), _packed("0", 4), *(_packed(v, 4) for v in ("k % 90", "1", "k % 60", "1", "k % 59", "10"))]
    return rows.selectExpr("k AS image_id", f"unhex(concat({', '.join(parts)})) AS exif")


#: Characters a line of a page of text.
LINE = 64


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of ink as their texts, LINE characters a line: image_id and text, a page a row."""
    return table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("image_id"), "text")


def ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a page of 64 characters a line; what isn't white space is ink. Null and empty texts are pages without pixels."""
    pages = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "")).alias("i", "c"))
    return pages.select("image_id", F.expr("i div 64").cast("int").alias("y"), F.expr("i % 64").cast("int").alias("x"), F.when(F.col("c").isin(" ", "\t", "\n"), 0).otherwise(1).alias("ink"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS img", "l_linenumber AS box", "CAST(l_partkey % 200 AS INT) AS x", "CAST(l_suppkey % 100 AS INT) AS y", "CAST(1 + l_quantity AS INT) AS w", "CAST(1 + l_partkey % 37 AS INT) AS h")
