"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterfold.llm.common import WORD, durable, numbered, running, text_of

WEIGHTS = (5, 2, 1)
#: The mix has 1.5 times the words of all documents; no source is taken more than twice.
TOTAL_PARTS, WHOLE_PARTS, MOST = 3, 2, 2
#: The mix has at least so many blocks, and the smallest target at least so many (blocks of one word: as many as it has words); shards they fill.
BLOCKS, FINENESS, SHARDS, SEED = 16384, 64, 16, "mix-2"
#: Tables of at most so many rows are put in order by one task.
FEW = 4096


def n_words(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def in_order(frame: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """frame with place (from 1 on in that order) and, for each name in sums, the sum of its column over the rows before.

    The rows are cut into ranges of the order, and only one row for each range meets the others;
    few rows are put in order as they are, with the same result.
    """
    if frame.count() <= FEW:
        before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return frame.select("*", F.row_number().over(W.orderBy(*order)).alias("place"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for name, c in sums.items()))
    cut = durable(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    of_range = cut.groupBy("_range").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = of_range.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", *(f"_{name}" for name in sums))))
    within = W.partitionBy("_range").orderBy(*order)
    before = within.rowsBetween(W.unboundedPreceding, -1)
    both = cut.join(F.broadcast(offsets), "_range")
    columns = [(F.col(f"_{name}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(name) for name, c in sums.items()]
    return both.select(*frame.columns, (F.col("_n") + F.row_number().over(within)).alias("place"), *columns)


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, target, place, words: what each source is to give.

    Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating. Targets follow the
    weights up to twice the source; what lies above is shared again until no target is above. That
    ends where all open targets have one ratio to their weights, found here by ordering sources by
    the ratio at which each one is full.
    """
    ranked = in_order(sources.select("source", "source_size"), [F.col("source").asc_nulls_last()])
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", F.col("place").alias("first_place"), weights.cast("long").alias("weight"), (F.lit(MOST) * F.col("source_size")).alias("most"))
    steps = durable(in_order(ranked, [F.col("most") / F.col("weight"), F.col("first_place")], full="most", earlier="weight"))
    whole = steps.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    words = (whole["size"] or 0) * TOTAL_PARTS / WHOLE_PARTS
    ratio = (F.lit(words) - F.col("full")) / (F.lit(whole["weight"] or 0) - F.col("earlier"))
    level = steps.agg(F.min(F.when(ratio * F.col("weight") <= F.col("most"), F.struct(F.col("full"), ratio.alias("ratio")))).alias("level")).first()["level"]
    target = F.least(F.col("most").cast("double"), F.lit(level["ratio"] if level else 0.0) * F.col("weight"))
    return steps.select("source", "source_size", target.alias("target"), F.col("first_place").alias("place"), F.lit(words).alias("words"))


def quotas(wanted: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, fineness: int = FINENESS) -> DataFrame:
    """source, block_words, ends: how many blocks each source has given when each shard is full, so the last is its share of the mix.

    A block goes to the source with the highest quotient target / (2 i - 1) for its i-th block.
    The quotients down to half a block are awarded, which rounds every target to whole blocks (the
    divisor form of Sainte-Lague); what is then missing of the mix, or too much, is settled by one
    block each, at the highest (lowest) quotients. Shard k is full when the quotients down to half
    a block times shards / k are awarded, so all shards keep the proportions. No source exceeds
    twice its size. Blocks are so small that the smallest target has fineness of them (but not
    less than a word), so that rare sources come near their targets too.
    """
    known = wanted.agg(F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least"), F.first("words").alias("words")).first()
    words = known["words"] or 0.0
    size = max(1, min(int(words // blocks), int((known["least"] or 0.0) // fineness)))
    most = F.floor(F.lit(MOST) * F.col("source_size") / size).cast("long")
    ends = [F.least(most, F.floor(F.col("target") * k / (shards * size) + 0.5).cast("long")) for k in range(1, shards + 1)]
    rounded = durable(wanted.select("source", "place", "target", most.alias("most"), F.array(*ends).alias("ends"), ends[-1].alias("won")))
    missing = int(words // size) - (rounded.agg(F.sum("won")).first()[0] or 0)
    step = 1 if missing > 0 else -1
    able = (F.col("won") < F.col("most")) & (F.col("target") > 0) if missing > 0 else F.col("won") > 0
    quotient = F.when(able, step * F.col("target") / (2 * F.col("won") + step))
    ranked = in_order(rounded.withColumn("quotient", quotient).withColumnRenamed("place", "source_place"), [F.col("quotient").desc_nulls_last(), F.col("source_place")])
    settled = F.col("won") + F.when(F.col("quotient").isNotNull() & (F.col("place") <= abs(missing)), step).otherwise(0)
    given = F.transform(F.slice("ends", 1, shards - 1), lambda x: F.least(x, settled))
    return ranked.select("source", F.lit(size).cast("long").alias("block_words"), F.concat(given, F.array(settled)).alias("ends"))


def _given(rows: DataFrame, blocks: int, shards: int, fineness: int) -> DataFrame:
    """rows (doc_id, source, size, drawn, tie and others) with source_size, target, block_words, ends, begin, taken, passes, rest."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = durable(targets(sizes))
    sources = wanted.alias("w").join(quotas(wanted, blocks, shards, fineness).alias("q"), F.expr("w.source <=> q.source"))
    sources = durable(sources.select(F.col("w.source").alias("of_source"), "source_size", "target", "block_words", "ends"))
    stream = rows.withColumn("stream", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")))
    placed = running(stream, "stream", [F.col(c).asc() for c in ("drawn", "doc_id", "size", "tie")], upto="sum(size)").drop("stream", "at")
    facts = F.broadcast(sources) if sources.count() <= FEW else sources
    placed = placed.join(facts, F.expr("source <=> of_source")).drop("of_source").withColumn("begin", F.col("upto") - F.col("size"))
    share = F.element_at("ends", -1) * F.col("block_words")
    whole = F.when(F.col("source_size") > 0, F.floor(share / F.col("source_size"))).otherwise(0).cast("long")
    left = share - whole * F.col("source_size") - F.col("begin")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    placed = placed.withColumn("taken", taken)
    passes = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    return placed.withColumn("passes", passes).withColumn("rest", F.col("taken") - F.col("passes") * F.col("size"))


def _drawn(rows: DataFrame, seed: str) -> DataFrame:
    """What orders a source's documents: the MD5 of seed and doc_id, and for rows that repeat an id a hash of the text."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return rows.select("*", n_words().alias("size"), drawn.alias("drawn"), F.xxhash64(text_of()).alias("tie")).drop("text")


def mix(docs: DataFrame, seed: str = SEED, blocks: int = BLOCKS, shards: int = SHARDS, fineness: int = FINENESS) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken, passes, rest, parts.

    size counts words (null text: 0). A source's documents, in an order drawn by the seed, form a
    stream of words that is cut into equal blocks; after the last document it begins again. Shard
    after shard takes its quota of blocks from it, so the seed decides which blocks a shard gets.
    parts lists what the shards take of a document: shard (from 0), block (the number in the stream
    in which it begins, from 0), start (word in the document) and words; taken is their sum, which
    are whole passes and the first rest of the words.

    Documents are ordered by the MD5 of seed and doc_id, then doc_id and size, so reruns agree;
    rows that repeat a document count each, ordered by a hash of the text. A null source is a source
    of its own; sources without words give none. An empty table gives no rows; other columns are
    ignored, and texts of any length are counted whole.

    The place of a document in the stream is a running sum over ranges of the order, so a source,
    an id or copies of one row with most of the rows are spread over tasks. Only ids, sizes,
    hashes and sources are shuffled.
    """
    placed = _given(durable(_drawn(docs.select("doc_id", "source", "text"), seed)), blocks, shards, fineness)

    def part(k: int, turn: int) -> Column:
        """What shard k takes of the document when the stream runs for the turn-th time (from 0)."""
        begin = F.col("begin") + turn * F.col("source_size")
        low = F.greatest(begin, F.element_at("ends", k) * F.col("block_words") if k else F.lit(0).cast("long"))
        high = F.least(begin + F.col("size"), F.element_at("ends", k + 1) * F.col("block_words"))
        return F.struct(F.lit(k).alias("shard"), F.floor(low / F.col("block_words")).alias("block"), (low - begin).alias("start"), (high - low).alias("words"))

    parts = F.filter(F.array(*(part(k, turn) for turn in range(MOST) for k in range(shards))), lambda p: p["words"] > 0)
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "rest", parts.alias("parts"))


def mixed(docs: DataFrame, seed: str = SEED, blocks: int = BLOCKS, shards: int = SHARDS, fineness: int = FINENESS) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each pass, texts cut where the last word taken ends.

    Documents without words take no part. A text that is taken to the end is returned as it is; one
    that the last word of its source cuts has its first words, joined by spaces, and n_chars (if
    docs has it) follows. Rows that repeat, and rows without doc_id, are taken each by itself. A
    null source is a source of its own. An empty table gives no rows. Other columns, whatever their
    names, stay as they are.

    Rows are numbered, and the texts meet what is taken of each in one join.
    """
    rows = numbered(docs)
    drawn = durable(_drawn(rows.select("nth", "doc.doc_id", F.col("doc.source").cast("string").alias("source"), F.col("doc.text").alias("text")), seed))
    times = F.concat(F.array_repeat("size", F.col("passes").cast("int")), F.when(F.col("rest") > 0, F.array("rest")).otherwise(F.array().cast("array<bigint>")))
    taken = _given(drawn, blocks, shards, fineness).where("taken > 0").select("nth", "size", times.alias("times"))
    out = rows.join(taken, "nth").select("doc", "size", F.explode("times").alias("take"))
    cut = F.col("take") < F.col("size")
    first = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)), 1, F.col("take").cast("int")), " ")
    fresh = {"text": F.when(cut, first).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(cut, F.char_length(first).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return out.select(*(fresh.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS drawn
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, 2 * source_size AS most FROM s),
v AS (SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT] AS weight FROM r),
c AS (
  SELECT *, coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
         (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS unfilled,
         (sum(source_size) OVER ())::DOUBLE * 3 / 2 AS words
  FROM v WINDOW o AS (ORDER BY most::DOUBLE / weight, place)),
l AS (SELECT coalesce(min_by((words - filled) / unfilled, filled) FILTER ((words - filled) / unfilled * weight <= most), 0.0) AS ratio FROM c),
t AS (SELECT source, source_size, place, words, least(most::DOUBLE, ratio * weight) AS target FROM c, l),
b AS (SELECT greatest(1, least(floor(any_value(words) / {BLOCKS}), floor(coalesce(min(target) FILTER (target > 0), 0) / {FINENESS})))::BIGINT AS block_words FROM t),
a AS (
  SELECT *, 2 * source_size // block_words AS most,
         list_transform(range(1, {SHARDS} + 1), lambda k: least(2 * source_size // block_words, floor(target * k / ({SHARDS} * block_words) + 0.5)::BIGINT)) AS ends
  FROM t, b),
g AS (SELECT *, ends[{SHARDS}] AS won, (floor(words / block_words)::BIGINT - sum(ends[{SHARDS}]) OVER ())::BIGINT AS missing FROM a),
h AS (SELECT *, CASE WHEN missing > 0 AND won < most AND target > 0 THEN target / (2 * won + 1)
                     WHEN missing <= 0 AND won > 0 THEN -target / (2 * won - 1) END AS quotient FROM g),
i AS (SELECT *, won + CASE WHEN quotient IS NOT NULL AND row_number() OVER (ORDER BY quotient DESC NULLS LAST, place) <= abs(missing) THEN sign(missing) ELSE 0 END AS blocks FROM h),
q AS (SELECT source, source_size, target, (blocks * block_words)::BIGINT AS words_taken,
             list_transform(ends[:{SHARDS - 1}], lambda e: (least(e, blocks) * block_words)::BIGINT) AS shard_ends FROM i),
p AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.words_taken, q.shard_ends,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.drawn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
z AS (
  SELECT *, (CASE WHEN source_size = 0 THEN 0 ELSE words_taken // source_size * size
                  + greatest(0, least(size, words_taken % source_size - begin_at)) END)::BIGINT AS taken
  FROM p)
SELECT doc_id, size, source_size, target, taken,
       (CASE WHEN taken > 0 THEN len(list_filter(shard_ends, lambda e: e <= begin_at)) ELSE -1 END)::INT AS first_shard
FROM z
"""
