"""What the operators of this subpackage share: reading tables, cutting lineage, text rules."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of the filters that are broadcast within plans: 4 MB, whatever they are made of.
FILTER_BITS = 1 << 25
_MAP = 1 << 15

#: Rows from which on a key counts as hot, and the parts that the rows of a hot key are dealt over.
HOT_ROWS, HOT_PARTS = 1024, 256

#: ASCII white space, the only separator that the text contracts know.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def durable(frame: DataFrame) -> DataFrame:
    """The frame's rows, written to the shared checkpoint folder: its lineage ends there.

    The folder is the one that the session names in ``spark.checkpoint.dir``. A temporary folder
    is used only by local sessions that name none, such as tests; on a cluster, whose executors
    wouldn't share it, a missing setting is an error.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return frame.checkpoint(eager=True)


def whole_row(docs: DataFrame, *without: str) -> Column:
    """All columns of docs (but for some) as one struct, in which no name can clash with another."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in without))


def numbered(docs: DataFrame) -> DataFrame:
    """nth, doc: each row of docs as a struct of all its columns, with a number of its own, also where rows repeat.

    Written to the checkpoint folder, so that a row has the same number whenever it is read; as all
    columns are inside the struct, none can clash with a name that an operator uses.
    """
    return durable(docs.select(F.monotonically_increasing_id().alias("nth"), whole_row(docs).alias("doc")))


def kept(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of a numbered table whose nth is in keep, as they were."""
    return rows.join(keep.select("nth"), "nth", "left_semi").select("doc.*")


def perhaps_among(frame: DataFrame, keys: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """frame with a column _among: false where column is certainly not among the keys.

    The keys are hashed into a bitmap of bits / 8 bytes at most, hence the broadcast; the fuller it
    is, the more rows are let through in vain. None is lost.
    """
    slot = F.pmod(F.xxhash64(column), F.lit(bits))
    bitmap = keys.select(slot.alias("s")).groupBy(F.floor(F.col("s") / _MAP).cast("int").alias("_part")).agg(F.bitmap_construct_agg(F.col("s") % _MAP).alias("_map"))
    at = slot % _MAP
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = frame.withColumn("_part", F.floor(slot / _MAP).cast("int")).join(F.broadcast(bitmap), "_part", "left")
    return marked.withColumn("_among", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_part", "_map")


def join_spread(rows: DataFrame, facts: DataFrame, key: str, n_rows: str, spread_by: str, hot_rows: int = HOT_ROWS, parts: int = HOT_PARTS) -> DataFrame:
    """rows joined to facts (one row for each key) on key, with the rows of hot keys dealt over parts tasks.

    Keys are hot where the column n_rows of facts says at least hot_rows, so the copies of their
    facts are at most parts / hot_rows of the rows. Which keys are hot is told by a filter of fixed
    size on both sides; a key that it confuses with a hot one is dealt in the same way. spread_by
    is a column of rows that differs within a key. facts are read several times, so they should be
    durable; that also lets them be joined without being dealt with rows.
    """
    hot = facts.where(F.col(n_rows) >= hot_rows).select(key)
    if hot.isEmpty():
        return rows.join(facts, key)
    dealt = perhaps_among(rows, hot, key).withColumn("_salt", F.when(F.col("_among"), F.pmod(F.xxhash64(spread_by), F.lit(parts))).otherwise(F.lit(0)).cast("int")).drop("_among")
    copies = F.when(F.col("_among"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    given = perhaps_among(facts, hot, key).withColumn("_salt", F.explode(copies)).drop("_among")
    return dealt.join(given, [key, "_salt"]).drop("_salt")


def running(rows: DataFrame, key: str, order: list[Column], **sums: str) -> DataFrame:
    """rows with at (place within its key, from 1) and, for each name in sums, that aggregate over the key's rows up to this one.

    sums are SQL aggregates that can be merged by themselves, written with the column: "sum(n)",
    "bit_xor(h)". Rows are cut into ranges of key and order, so a key with most of the rows is
    spread; only one row for each key and range meets others of its key. Rows that are equal in
    key and order are told apart by their place in rows, which should be durable.
    """
    order = [*order, F.col("_nth").asc()]
    cut = durable(rows.withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()))
    of_range = cut.groupBy("_range", key).agg(F.count("*").alias("_before"), *(F.expr(of).alias(f"_{name}") for name, of in sums.items()))
    earlier = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    merged = {name: f"{of.split('(')[0]}(_{name})" for name, of in sums.items()}
    offsets = of_range.select("_range", key, F.coalesce(F.sum("_before").over(earlier), F.lit(0)).alias("_before"), *(F.coalesce(F.expr(of).over(earlier), F.lit(0)).alias(f"_{name}") for name, of in merged.items()))
    within = W.partitionBy("_range", key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = cut.join(offsets, ["_range", key])
    for name, of in sums.items():
        both = F.col(f"_{name}").bitwiseXOR(F.expr(of).over(within)) if of.startswith("bit_xor") else F.col(f"_{name}") + F.expr(of).over(within)
        out = out.withColumn(name, both)
    return out.withColumn("at", F.col("_before") + F.row_number().over(W.partitionBy("_range", key).orderBy(*order))).select(*rows.columns, *sums, "at")


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of a text's UTF-8 bytes: eight steps of the polynomial for each byte."""
    data = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    step = "list_reduce(range(8), lambda k, i: CASE WHEN k & 1 = 1 THEN xor(3988292384, k >> 1) ELSE k >> 1 END, xor(c, b))"
    return f"xor(4294967295, list_reduce({data}, lambda c, b: {step}, 4294967295::BIGINT))"
