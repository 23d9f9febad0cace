"""Short texts that stand for a blurred image: made from pixels, checked, and made into pixels again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.functions import color
from rasterfold.functions.numbers import byte, clamp, from_unit, num
from rasterfold.operators.cut import written
from rasterfold.operators.pixels import sized

#: The digits of base 83, a fixed value.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz#$%*+,-.:;=?@[]^_{|}~"
MOST = 9


def digits(value: str, n: int) -> str:
    """SQL for the last n digits of a whole number in base 83."""
    return "concat(" + ", ".join(f"substr('{DIGITS}', CAST(floor({value} / {num(83**k)}) AS BIGINT) % 83 + 1, 1)" for k in range(n - 1, -1, -1)) + ")"


def factor(channel: str, i: int, j: int) -> str:
    """SQL for a component: the mean of a channel's light times its cosines over an image with width and height."""
    return f"round({1 if i == j == 0 else 2} * sum({color.linear(channel)} * cos({num(math.pi * i)} * x / width) * cos({num(math.pi * j)} * y / height)) / count(*), 9)"


def steps(i: int, j: int) -> tuple[dict[str, str], str, str]:
    """SQL for the factors (by name) of i x j components, for their largest step, and for the text made of them."""
    places = [(u, v) for v in range(j) for u in range(i)]
    factors = {f"f{n}_{c}": factor(c, u, v) for n, (u, v) in enumerate(places) for c in "rgb"}
    ac = [f"f{n}_{c}" for n in range(1, len(places)) for c in "rgb"]
    most = byte(f"least(82, floor(greatest({', '.join(f'abs({f})' for f in ac)}) * 166e0 - 0.5e0))") if ac else "0"
    size = digits(str(i - 1 + (j - 1) * 9), 1)
    shade = lambda f: from_unit(color.linear_to_srgb(clamp(f, "0e0", "1e0")))
    share = "((most + 1) / 166e0)"
    quantised = lambda f: f"CAST({clamp(f'floor(sign({f}) * sqrt(abs({f} / {share})) * 9 + 9.5e0)', '0', '18')} AS INT)"
    first = digits(f"({shade('f0_r')} * 65536 + {shade('f0_g')} * 256 + {shade('f0_b')})", 4)
    rest = [digits(f"({quantised(f'f{n}_r')} * 361 + {quantised(f'f{n}_g')} * 19 + {quantised(f'f{n}_b')})", 2) for n in range(1, len(places))]
    return factors, most, f"concat({', '.join([size, digits('most', 1), first, *rest])})"


def blur_hash(px: DataFrame, i: int = 4, j: int = 3) -> DataFrame:
    """image_id, hash: i x j components (1 to 9 each) of every image (r, g, b), by sums over its pixels."""
    if not (1 <= i <= MOST and 1 <= j <= MOST):
        raise ValueError(f"components are 1 to {MOST} each way")
    factors, most, text = steps(i, j)
    sums = sized(px).groupBy("image_id").agg(*(F.expr(e).alias(name) for name, e in factors.items()))
    return sums.withColumn("most", F.expr(most)).select("image_id", F.expr(text).alias("hash"))


def _number(text: Column, at: Column | int, n: int) -> Column:
    """The value of n digits from place at (from 0) on; null where one isn't a digit."""
    total = F.lit(0)
    for k in range(n):
        place = F.instr(F.lit(DIGITS), F.substring(text, (F.lit(at) if isinstance(at, int) else at) + k + 1, F.lit(1)))
        total = total * 83 + F.when(place > 0, place - 1)
    return total


def components(texts: DataFrame, hash: str = "hash") -> DataFrame:
    """texts with valid, components_x, components_y: whether a text is such a hash (null ones aren't), and its numbers of components, null if not."""
    text = F.col(hash)
    flag = _number(text, 0, 1)
    x, y = flag % MOST + 1, F.floor(flag / MOST).cast("int") + 1
    sound = (F.length(text) >= 6) & (F.translate(text, DIGITS, "") == "") & (y <= MOST) & (F.length(text) == 4 + 2 * x * y) & (_number(text, 2, 4) <= 0xFFFFFF)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), x * y - 1)), lambda c: _number(text, 4 + 2 * c, 2))
    valid = F.coalesce(sound & ((x * y == 1) | ~F.exists(parts, lambda v: v >= 19**3)), F.lit(False))
    return texts.select("*", valid.alias("valid"), F.when(valid, x).cast("int").alias("components_x"), F.when(valid, y).cast("int").alias("components_y"))


def from_blur_hash(texts: DataFrame, width: int, height: int, punch: float = 1.0, hash: str = "hash") -> DataFrame:
    """image_id, y, x, r, g, b of each valid text (image_id, hash); others give no pixels."""
    known = components(written(texts.select("image_id", F.col(hash).alias("hash")))).where("valid")
    text, count = F.col("hash"), F.col("components_x") * F.col("components_y")
    most = (_number(text, 1, 1) + 1) / 166.0 * punch
    first = _number(text, 2, 4)
    light = lambda v: F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    mean = F.struct(*(light(F.floor(first / 256**k) % 256 / 255).alias(c) for k, c in zip((2, 1, 0), "rgb", strict=True)))
    wave = lambda v, k: (lambda q: F.signum(q) * q * q * most)((F.floor(v / 19**k) % 19 - 9) / 9.0)
    others = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), count - 1)), lambda c: (lambda v: F.struct(*(wave(v, k).alias(ch) for k, ch in zip((2, 1, 0), "rgb", strict=True))))(_number(text, 4 + 2 * c, 2)))
    # Texts and waves are written, so that none is made anew for each digit or pixel.
    known = written(known.select("image_id", "components_x", F.concat(F.array(mean), F.when(count > 1, others).otherwise(F.slice(others, 1, 0))).alias("waves")))
    rows = known.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    basis = lambda n: F.cos(math.pi * F.col("x") * (n % F.col("components_x")) / width) * F.cos(math.pi * F.col("y") * F.floor(n / F.col("components_x")) / height)
    sums = {c: F.aggregate(F.transform("waves", lambda w, n: w[c] * basis(n)), F.lit(0.0), lambda a, b: a + b) for c in "rgb"}  # noqa: B023
    shown = rows.select("image_id", "y", "x", *(F.round(v, 9).alias(c) for c, v in sums.items()))
    return shown.selectExpr("image_id", "y", "x", *(f"{from_unit(color.linear_to_srgb(clamp(c, '0e0', '1e0')))} AS {c}" for c in "rgb"))
