"""Tags of EXIF blocks as rows: directories of a binary column walked with expressions, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterfold.operators.cut import written

#: Bytes of each type of value (1 to 10), and the tags that point to other directories.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
POINTERS = {34665: "photo", 34853: "gps", 40965: "interoperability"}


def _number(at: str, n: int, signed: bool = False) -> str:
    """SQL for the whole number in n bytes of exif from place at (from 0) on, in the block's byte order (big)."""
    byte = [f"coalesce(CAST(conv(hex(substring(exif, CAST({at} AS INT) + {k + 1}, 1)), 16, 10) AS BIGINT), 0L)" for k in range(n)]
    total = lambda order: " + ".join(f"{b} * {256**k}L" for k, b in enumerate(order))
    value = f"(CASE WHEN big THEN {total(byte[::-1])} ELSE {total(byte)} END)"
    return f"({value} - CASE WHEN {value} >= {1 << 8 * n - 1}L THEN {1 << 8 * n}L ELSE 0L END)" if signed else value


def _entries(directories: DataFrame) -> DataFrame:
    """The entries of directories (image_id, exif, big, directory, start), and where the next directory is."""
    fits = "start >= 8 AND start + 2 <= length(exif)"
    counted = directories.where(fits).withColumn("entries", F.expr(_number("start", 2)))
    counted = counted.where("entries > 0").withColumn("entries", F.expr("least(entries, (length(exif) - start - 2) div 12)")).where("entries > 0")
    counted = counted.withColumn("next", F.expr(f"CASE WHEN start + 6 + entries * 12 <= length(exif) THEN {_number('start + 2 + entries * 12', 4)} ELSE 0L END"))
    rows = counted.withColumn("entry", F.explode(F.expr("sequence(0L, entries - 1)"))).withColumn("at", F.expr("start + 2 + entry * 12"))
    rows = rows.selectExpr("image_id", "exif", "big", "directory", "entry", "at", "next", f"CAST({_number('at', 2)} AS INT) AS tag", f"CAST({_number('at + 2', 2)} AS INT) AS type", f"{_number('at + 4', 4)} AS count", f"{_number('at + 8', 4)} AS value")
    return written(rows)  # read several times, and short for its many digits


def exif_tags(files: DataFrame, exif: str = "exif") -> DataFrame:
    """image_id, directory (image, thumbnail, photo, gps, interoperability), tag, type, count, text, numbers of each tag in files (image_id, a binary column).

    text has the characters of a text up to its end mark, and bytes in hexadecimal; numbers are whole
    numbers and quotients (null over 0). Both byte orders are read. A value that isn't whole within
    the block has neither text nor numbers; blocks that are no such blocks, are cut before their
    first directory, or null give no rows; a directory's entries beyond the block's end are left
    out. Directories are followed as the standard nests them, so no block can lead in circles.
    """
    block = files.select("image_id", F.col(exif).alias("exif")).where("length(exif) >= 8")
    # A block may begin with the marker that files have before it.
    block = block.withColumn("exif", F.expr("CASE WHEN substring(exif, 1, 6) = X'457869660000' THEN substring(exif, 7) ELSE exif END"))
    block = written(block.withColumn("big", F.expr("substring(exif, 1, 2) = X'4D4D'"))).where("(big OR substring(exif, 1, 2) = X'4949')").where(f"{_number('2', 2)} = 42")
    first = _entries(block.withColumns({"directory": F.lit("image"), "start": F.expr(_number("4", 4))}))
    ahead = first.where("entry = 0 AND next > 0").select("image_id", "exif", "big", F.lit("thumbnail").alias("directory"), F.col("next").alias("start"))
    name = F.coalesce(*(F.when(F.col("tag") == t, n) for t, n in POINTERS.items()))
    below = lambda rows, tags: rows.where(F.col("tag").isin(*tags) & (F.col("type") == 4)).select("image_id", "exif", "big", name.alias("directory"), F.col("value").alias("start"))
    second = _entries(below(first, (34665, 34853)).unionByName(ahead))
    third = _entries(below(second.where("directory = 'photo'"), (40965,)))
    rows = first.unionByName(second).unionByName(third)

    size = F.coalesce(*(F.when(F.col("type") == t, n) for t, n in SIZES.items()))
    rows = rows.withColumn("size", size)
    rows = written(rows.withColumn("data", F.expr("CASE WHEN count * size <= 4 THEN at + 8 ELSE value END")).withColumn("whole", F.expr("size IS NOT NULL AND count > 0 AND data >= 0 AND data + count * size <= length(exif)")))
    place = "data + i * size"
    quotient = lambda signed: f"CASE WHEN {_number(f'{place} + 4', 4, signed)} <> 0 THEN {_number(place, 4, signed)} / CAST({_number(f'{place} + 4', 4, signed)} AS DOUBLE) END"
    kinds = {3: _number(place, 2), 4: _number(place, 4), 5: quotient(False), 8: _number(place, 2, True), 9: _number(place, 4, True), 10: quotient(True)}
    one = "CASE type " + " ".join(f"WHEN {t} THEN CAST({e} AS DOUBLE)" for t, e in kinds.items()) + " END"
    numbers = F.expr(f"CASE WHEN whole AND type IN ({', '.join(map(str, kinds))}) THEN transform(sequence(0L, count - 1), i -> {one}) END")
    raw = "substring(exif, CAST(data AS INT) + 1, CAST(count AS INT))"
    text = F.expr(f"CASE WHEN whole AND type = 2 THEN split_part(decode({raw}, 'UTF-8'), char(0), 1) WHEN whole AND type IN (1, 6, 7) THEN lower(hex({raw})) END")
    return rows.select("image_id", "directory", "tag", "type", "count", text.alias("text"), numbers.alias("numbers"))
