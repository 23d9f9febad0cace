"""Exact deduplication: group by a 128-bit content hash, then compare bytes inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.llm.common import FILTER_BITS, HOT_ROWS, SPACE, durable, join_spread, kept, numbered, perhaps_among, text_of


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), SPACE, "")


def first_half(sha256: Column) -> Column:
    """The first 128 bits of a hexadecimal SHA-256."""
    return F.unhex(F.substring(sha256, 1, 32))


def _best() -> Column:
    return F.max(F.struct("n_code", F.negative("doc_id").alias("minus_id"), "copies"))


def _collided(hashed: DataFrame, groups: DataFrame, filter_bits: int) -> DataFrame:
    """h of groups of two and more (column group_size) that stands for different texts: texts are compared by grouping on them."""
    shared = groups.where("group_size > 1").select("h")
    texts = perhaps_among(hashed, shared, "h", filter_bits).where("_among").groupBy("h", "norm").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("n_texts"))
    return durable(texts.where("n_texts > 1").select("h"))


def exact_groups(docs: DataFrame, content_hash: Callable[[Column], Column] = first_half, filter_bits: int = FILTER_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, h, keep_copies.

    Texts are equal when identical without ASCII white space; null counts as empty. Of equal texts
    the longest original (code points), then the smallest doc_id stays; a null doc_id comes last.
    Rows that repeat a doc_id with an equal text are one document: each is a row with the same
    verdict, group_size counts them all, and keep_copies tells how many rows the kept id has.
    An empty table gives no rows; other columns are ignored.

    Only hashes and lengths are shuffled for the grouping, aggregated per (hash, doc_id) and then
    per hash before each shuffle. Texts travel only for groups of two and more, one for each
    distinct text and map task, and are compared by grouping on the text itself. Where one hash
    stands for two texts, these rows are grouped by text. Rows get their group's verdict by a join
    that deals the rows of groups of hot_rows and more over many tasks.
    """
    hashed = docs.select("doc_id", normalised().alias("norm"), F.char_length(text_of()).alias("n_code")).withColumn("text_sha256", F.sha2("norm", 256))
    hashed = hashed.withColumn("h", content_hash(F.col("text_sha256")))
    rows = durable(hashed.select("doc_id", "n_code", "text_sha256", "h"))
    groups = rows.groupBy("h", "doc_id").agg(F.count("*").alias("copies"), F.max("n_code").alias("n_code")).groupBy("h").agg(F.sum("copies").alias("group_size"), _best().alias("best"))
    groups = durable(groups)
    keep = [F.negative("best.minus_id").alias("keep_id"), F.col("best.copies").alias("keep_copies"), "group_size"]

    collided = _collided(hashed, groups, filter_bits)
    out = ["doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256", "h", "keep_copies"]
    if collided.isEmpty():
        return join_spread(rows, groups.select("h", *keep), "h", "group_size", "doc_id", hot_rows).select(*out)
    apart = hashed.join(collided, "h", "left_semi")
    by_text = apart.groupBy("h", "norm", "doc_id").agg(F.count("*").alias("copies"), F.max("n_code").alias("n_code")).groupBy("h", "norm").agg(F.sum("copies").alias("group_size"), _best().alias("best"))
    plain = join_spread(rows.join(collided, "h", "left_anti"), groups.select("h", *keep), "h", "group_size", "doc_id", hot_rows).select(*out)
    return plain.unionByName(apart.join(by_text.select("h", "norm", *keep), ["h", "norm"]).select(*out))


def without_copies(docs: DataFrame, content_hash: Callable[[Column], Column] = first_half, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The documents that stay, with the columns of docs: one row of each group of equal texts.

    The longest original stays, then the smallest doc_id (null last), then the row with the largest
    hash of all its columns, so that reruns agree. Null and empty texts are equal and leave one
    row. An empty table gives no rows. Other columns, whatever their names, stay as they are.

    Rows are numbered; only numbers, ids, lengths and hashes are grouped, and the texts meet the
    numbers that stay in one join.
    """
    rows = numbered(docs)
    hashed = rows.select("nth", "doc.doc_id", F.xxhash64("doc").alias("row"), normalised("doc.text").alias("norm"), F.char_length(text_of("doc.text")).alias("n_code"))
    hashed = hashed.withColumn("h", content_hash(F.sha2("norm", 256)))
    best = F.max(F.struct("n_code", F.negative("doc_id").alias("minus_id"), "row", "nth")).alias("best")
    groups = durable(durable(hashed.drop("norm")).groupBy("h").agg(F.count("*").alias("group_size"), best))
    collided = _collided(hashed, groups, filter_bits)
    stay = groups.select("h", "best.nth")
    if not collided.isEmpty():
        apart = hashed.join(collided, "h", "left_semi").groupBy("h", "norm").agg(best)
        stay = stay.join(collided, "h", "left_anti").unionByName(apart.select("h", "best.nth"))
    return kept(rows, stay)


EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_code,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_code DESC, doc_id NULLS LAST)
"""
