"""Placeholders of about 25 bytes: shape, mean colour, transparency and coarse waves of an image, packed by half bytes.

An image's light (l), yellow against blue (p), red against green (q) and alpha are written as cosine
waves: l in up to 7 x 7 of them by the image's shape, p and q in 3 x 3, alpha in 5 x 5; of each only
those below the diagonal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.functions.numbers import num
from rasterfold.operators.cut import written
from rasterfold.operators.pixels import with_own

#: Waves along an axis of p and q, of alpha, and of l without and with transparency.
TINTS, ALPHA, LIGHT, LIGHT_OVER = 3, 5, 7, 5
_NAMES = ("l", "p", "q", "o")


def waves(n: int) -> list[tuple[int, int]]:
    """(across, down) of the waves below the diagonal of n x n, line by line."""
    return [(i, j) for j in range(n) for i in range(n - j)]


_KEPT = {"l": waves(LIGHT), "p": waves(TINTS), "q": waves(TINTS), "o": waves(ALPHA)}
#: SQL: transparency, the numbers of waves of l along each axis (lx, ly), and the four channels of a pixel over the mean colour.
SHAPE = {"lx": f"greatest(1, CAST(floor((CASE WHEN clear THEN {LIGHT_OVER} ELSE {LIGHT} END) * CAST(width AS DOUBLE) / greatest(width, height) + 0.5e0) AS INT))", "ly": f"greatest(1, CAST(floor((CASE WHEN clear THEN {LIGHT_OVER} ELSE {LIGHT} END) * CAST(height AS DOUBLE) / greatest(width, height) + 0.5e0) AS INT))"}
OVER = {f"o{c}": f"m{c} * (1 - a / 255e0) + a / 255e0 * ({c} / 255e0)" for c in "rgb"}
CHANNELS = {"l": "(or_ + og + ob) / 3e0", "p": "(or_ + og) / 2e0 - ob", "q": "or_ - og", "o": "a / 255e0"}
MEANS = [f"CASE WHEN sum(a) > 0 THEN sum(a / 255e0 * ({c} / 255e0)) / sum(a / 255e0) ELSE 0e0 END AS m{c}" for c in "rgb"]


def wave(channel: str, i: int, j: int) -> str:
    """SQL for the mean of a channel times a wave."""
    return f"round(sum(({CHANNELS[channel]}) * cos({num(math.pi * i)} * (x + 0.5e0) / width) * cos({num(math.pi * j)} * (y + 0.5e0) / height)) / count(*), 9)"


def thumb_hash(px: DataFrame) -> DataFrame:
    """image_id, hash: the bytes of each image's (r, g, b, a) placeholder in hexadecimal, from sums over its pixels."""
    facts = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), (F.sum("a") < 255 * F.count("*")).alias("clear"), *(F.expr(m) for m in MEANS))
    facts = facts.selectExpr("*", *(f"{e} AS {c}" for c, e in SHAPE.items()))
    over = with_own(px.select("image_id", "y", "x", *"rgba"), facts).selectExpr("*", *(f"{e} AS {'or_' if c == 'or' else c}" for c, e in OVER.items()))
    found = over.groupBy("image_id", "width", "height", "clear", "lx", "ly").agg(*(F.expr(wave(c, i, j)).alias(f"{c}_{i}_{j}") for c in _NAMES for i, j in _KEPT[c]))
    found = written(found)

    def kept(c: str) -> Column:
        """The waves of a channel but for its mean, in order; of l those that the image's shape keeps."""
        nx, ny = (F.greatest(F.lit(3), F.col(k)) for k in ("lx", "ly")) if c == "l" else (F.lit(0), F.lit(0))
        rows = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{c}_{i}_{j}").alias("f")) for i, j in _KEPT[c] if i or j]
        some = F.filter(F.array(*rows), lambda w: (w["i"] * ny < nx * (ny - w["j"]))) if c == "l" else F.array(*rows)
        return F.transform(some, lambda w: w["f"])

    found = found.select("image_id", "width", "height", "clear", "lx", "ly", *(F.col(f"{c}_0_0").alias(c) for c in _NAMES), *(kept(c).alias(f"w{c}") for c in _NAMES))
    found = found.select("*", *(F.coalesce(F.array_max(F.transform(f"w{c}", F.abs)), F.lit(0.0)).alias(f"s{c}") for c in _NAMES))
    whole = lambda e: F.floor(F.round(e, 9) + 0.5).cast("int")
    halves = lambda c: F.transform(f"w{c}", lambda f: F.when(F.col(f"s{c}") > 0, whole(15 * (0.5 + 0.5 / F.col(f"s{c}") * f))).otherwise(whole(15 * f)))
    wide = F.col("width") > F.col("height")
    first = whole(63 * F.col("l")) + whole(31.5 + 31.5 * F.col("p")) * 64 + whole(31.5 + 31.5 * F.col("q")) * 4096 + whole(31 * F.col("sl")) * 262144 + F.when(F.col("clear"), 1 << 23).otherwise(0)
    second = F.when(wide, F.col("ly")).otherwise(F.col("lx")) + whole(63 * F.col("sp")) * 8 + whole(63 * F.col("sq")) * 512 + F.when(wide, 1 << 15).otherwise(0)
    none = F.array().cast("array<int>")
    over_bytes = F.when(F.col("clear"), F.array(whole(15 * F.col("o")), whole(15 * F.col("so")))).otherwise(none)
    nibbles = F.concat(over_bytes, halves("l"), halves("p"), halves("q"), F.when(F.col("clear"), halves("o")).otherwise(none))
    nibbles = F.when(F.size(nibbles) % 2 == 1, F.concat(nibbles, F.array(F.lit(0)))).otherwise(nibbles)
    found = found.select("image_id", first.alias("first"), second.alias("second"), nibbles.alias("n"))
    head = F.concat(*(F.lpad(F.hex(F.floor(F.col(c) / 256**k) % 256), 2, "0") for c, k in (("first", 0), ("first", 1), ("first", 2), ("second", 0), ("second", 1))))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("n") / 2).cast("int") - 1), lambda k: F.concat(F.hex(F.get("n", 2 * k + 1)), F.hex(F.get("n", 2 * k))))
    return found.select("image_id", F.lower(F.concat(head, F.array_join(pairs, ""))).alias("hash"))


def _byte(k: int) -> Column:
    return F.conv(F.substring("hash", 2 * k + 1, 2), 16, 10).cast("int")


def _bits(value: Column, low: int, n: int) -> Column:
    return F.floor(value / (1 << low)).cast("int") % (1 << n)


def headers(texts: DataFrame) -> DataFrame:
    """texts (image_id, hash) with what the first bytes say: clear, wide, lx, ly, aspect, means l, p, q, o and scales sl, sp, sq, so. Texts of fewer than 5 bytes go."""
    known = texts.where("length(hash) >= 10").select("*", (_byte(0) + _byte(1) * 256 + _byte(2) * 65536).alias("first"), (_byte(3) + _byte(4) * 256).alias("second"))
    first, second = F.col("first"), F.col("second")
    known = known.withColumns({"clear": _bits(first, 23, 1) == 1, "wide": _bits(second, 15, 1) == 1})
    most, given = F.when(F.col("clear"), LIGHT_OVER).otherwise(LIGHT), _bits(second, 0, 3)
    known = known.withColumns({"lx": F.when(F.col("wide"), most).otherwise(given), "ly": F.when(F.col("wide"), given).otherwise(most)})
    over = F.conv(F.substring("hash", 11, 2), 16, 10).cast("int")
    values = {
        "l": _bits(first, 0, 6) / 63, "p": _bits(first, 6, 6) / 31.5 - 1, "q": _bits(first, 12, 6) / 31.5 - 1, "sl": _bits(first, 18, 5) / 31, "sp": _bits(second, 3, 6) / 63, "sq": _bits(second, 9, 6) / 63,
        "o": F.when(F.col("clear"), over % 16 / 15).otherwise(1.0), "so": F.when(F.col("clear"), F.floor(over / 16) / 15).otherwise(0.0), "aspect": F.col("lx") / F.greatest(F.lit(1), F.col("ly")),
    }
    return known.withColumns(values).drop("first", "second")


def _colour(light: Column, p: Column, q: Column) -> dict[str, Column]:
    b = light - 2 / 3 * p
    r = (3 * light - b + q) / 2
    return {"r": r, "g": r - q, "b": b}


def _shown(e: Column) -> Column:
    return F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), e)) * 255, 6) + 0.5).cast("int")


def mean_colour(texts: DataFrame) -> DataFrame:
    """image_id, r, g, b, a, aspect: the mean colour of each text (image_id, hash) and about how wide its image is for its height."""
    known = headers(texts)
    return known.select("image_id", *(_shown(e).alias(c) for c, e in _colour(F.col("l"), F.col("p"), F.col("q")).items()), _shown(F.col("o")).alias("a"), F.round("aspect", 6).alias("aspect"))


def from_thumb_hash(texts: DataFrame, most: int = 32) -> DataFrame:
    """image_id, y, x, r, g, b, a of each text (image_id, hash): an image of the text's shape whose longer side is most."""
    known = headers(texts)
    nx, ny = F.greatest(F.lit(3), F.col("lx")), F.greatest(F.lit(3), F.col("ly"))
    square = F.flatten(F.transform(F.sequence(F.lit(0), ny - 1), lambda j: F.transform(F.sequence(F.lit(0), nx - 1), lambda i: F.struct(i.alias("i"), j.alias("j")))))
    fixed = lambda n: F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in waves(n) if i or j))
    places = {"l": F.filter(square, lambda w: (w["i"] * ny < nx * (ny - w["j"])) & (w["i"] + w["j"] > 0)), "p": fixed(TINTS), "q": fixed(TINTS), "o": F.when(F.col("clear"), fixed(ALPHA)).otherwise(F.slice(fixed(ALPHA), 1, 0))}
    known = known.select("*", *(e.alias(f"w{c}") for c, e in places.items()))
    begin = F.when(F.col("clear"), 12).otherwise(10)
    before = {"l": F.lit(0), "p": F.size("wl"), "q": F.size("wl") + F.size("wp"), "o": F.size("wl") + F.size("wp") + F.size("wq")}
    # The k-th half byte is the lower half of its byte first: digits come in swapped pairs.
    half = lambda k: F.coalesce(F.conv(F.substring("hash", (begin + F.floor(k / 2) * 2 + 2 - k % 2).cast("int"), F.lit(1)), 16, 10).cast("int"), F.lit(0))
    scale = {"l": F.col("sl"), "p": F.col("sp") * 1.25, "q": F.col("sq") * 1.25, "o": F.col("so")}

    def read(c: str) -> Column:
        return F.transform(f"w{c}", lambda w, n: F.struct(w["i"].alias("i"), w["j"].alias("j"), ((half(before[c] + n) / 7.5 - 1) * scale[c]).alias("f")))

    side = lambda e: F.greatest(F.lit(1), F.floor(e + 0.5)).cast("int")
    known = known.select("image_id", *_NAMES, *(read(c).alias(f"r{c}") for c in _NAMES), side(F.when(F.col("aspect") > 1, float(most)).otherwise(most * F.col("aspect"))).alias("w"), side(F.when(F.col("aspect") > 1, most / F.col("aspect")).otherwise(float(most))).alias("h"))
    rows = written(known).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    angle = lambda at, n: math.pi * (F.col(at) + 0.5) / F.col(n)
    total = {c: F.col(c) + F.aggregate(F.transform(f"r{c}", lambda w: w["f"] * 2 * F.cos(angle("x", "w") * w["i"]) * F.cos(angle("y", "h") * w["j"])), F.lit(0.0), lambda a, b: a + b) for c in _NAMES}
    sums = rows.select("image_id", "y", "x", *(e.alias(c) for c, e in total.items()))
    return sums.select("image_id", "y", "x", *(_shown(e).alias(c) for c, e in _colour(F.col("l"), F.col("p"), F.col("q")).items()), _shown(F.col("o")).alias("a"))
