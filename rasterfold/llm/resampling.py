"""Importance resampling towards a target: log-ratios of hashed n-grams, and a draw by the Gumbel trick."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterfold.llm.common import crc32_sql, durable, text_of
from rasterfold.llm.mixing import in_order

#: Words of a feature, buckets of the hash, hundredths of the documents that are drawn, least words of such a document.
N, BUCKETS, PER_CENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Texts of more bytes than this are cut into chunks of about this size, which are dealt over tasks.
CHUNK_BYTES = 1 << 15
_BLANK, _RUN = 32, re.compile(rb"[^ ]+")
#: ASCII: A-Z to small letters, digits and small letters stay, all else is blank; bytes of other characters stay.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _BLANK for b in range(256))


def chunks_of(text: bytes, n: int = N, size: int = CHUNK_BYTES) -> Iterator[tuple[bytes, int]]:
    """(words joined by blanks, how many of them the chunk owns) of consecutive chunks of a text.

    A chunk ends with the first word that ends size bytes or more after its begin, owns the words
    in it, and carries the next n - 1 words, so that the n-grams of its words are whole. A text
    without words is one empty chunk.
    """
    data = text.translate(_TO_WORDS)
    begin, none = 0, True
    while begin < len(data):
        end = data.find(b" ", begin + size)
        end = len(data) if end < 0 else end
        words = data[begin:end].split()
        if words:
            carried = (m.group() for m in islice(_RUN.finditer(data, end), n - 1))
            yield b" ".join((*words, *carried)), len(words)
            none = False
        begin = end
    if none:
        yield b"", 0


def buckets_of(words: list[bytes], owned: int, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each run of 1 to n words that begins at an owned word."""
    found = [np.fromiter(map(zlib.crc32, words[:owned]), np.int64, min(owned, len(words)))]
    for size in range(2, n + 1):
        runs = [b" ".join(words[at : at + size]) for at in range(min(owned, len(words) - size + 1))]
        found.append(np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)))
    return np.concatenate(found) % buckets


def chunked(docs: DataFrame, n: int = N, size: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Texts of docs (doc_id, text) of at most size bytes, whole; and the chunks of longer ones, dealt over tasks.

    Both have doc_id, nth (a number for each long text), words, owned (null: the words are a whole text).
    """
    docs = docs.select("doc_id", text_of().alias("text"))
    long = F.octet_length("text") > size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch["text"]):
                for words, owned in chunks_of(text.as_py().encode("utf-8", "surrogatepass"), n, size):
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, 1), batch["nth"].slice(at, 1), pa.array([words], pa.binary()), pa.array([owned], pa.int64())], ["doc_id", "nth", "words", "owned"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.where(long).withColumn("nth", F.monotonically_increasing_id())
    pieces = numbered.mapInArrow(cut, f"doc_id {kind}, nth long, words binary, owned long").repartition("nth", F.xxhash64("words"))
    none = F.lit(None).cast("long")
    whole = docs.where(~long).select("doc_id", none.alias("nth"), F.col("text").cast("binary").alias("words"), none.alias("owned"))
    return whole, pieces


def _words(row: bytes, owned: int | None) -> tuple[list[bytes], int]:
    words = (row if owned is not None else row.translate(_TO_WORDS)).split()
    return words, len(words) if owned is None else owned


def bucket_counts(chunks: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """bucket, count: features of all chunks, added up in each task before they are shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for row, owned in zip(batch["words"], batch["owned"].to_pylist(), strict=True):
                total += np.bincount(buckets_of(*_words(row.as_py(), owned), n, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "count"])

    return chunks.select("words", "owned").mapInArrow(counted, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, size: int = CHUNK_BYTES) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares in target and in docs) of each bucket: so many numbers, whatever the tables."""
    raw, aim = (bucket_counts(whole.unionByName(pieces), n, buckets) for whole, pieces in (chunked(docs, n, size), chunked(target, n, size)))
    both = raw.withColumn("wanted", F.lit(False)).unionByName(aim.withColumn("wanted", F.lit(True)))
    counts = np.zeros((2, buckets), np.int64)
    for row in both.collect():  # at most two rows for each bucket
        counts[int(row["wanted"]), row["bucket"]] = row["count"]
    (s, t), (total_s, total_t) = counts.astype(np.float64), counts.sum(1).tolist()
    return np.floor(1000 * np.log((t + 1) * (total_s + buckets) / ((s + 1) * (total_t + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int = N, size: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_features, total (of gains) of each text of docs; chunks are added up by document."""
    buckets, columns = len(gain), ("n_words", "n_features", "total")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, owned in zip(batch["words"], batch["owned"].to_pylist(), strict=True):
                words, owned = _words(row.as_py(), owned)
                at = buckets_of(words, owned, n, buckets)
                rows.append((owned, len(at), int(gain[at].sum())))
            sums = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["nth"], *(pa.array(sums[:, c]) for c in range(3))], ["doc_id", "nth", *columns])

    kind = docs.schema["doc_id"].dataType.simpleString()
    whole, parts = (x.mapInArrow(added, f"doc_id {kind}, nth long, {', '.join(f'{c} long' for c in columns)}") for x in chunked(docs, n, size))
    long = parts.groupBy("nth", "doc_id").agg(*(F.sum(c).alias(c) for c in columns))
    return whole.unionByName(long).drop("nth")


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED, size: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_features, weight, score, rank.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lowered; features are all
    runs of 1 to n of them, repeats counted, hashed into buckets. A bucket's gain compares its share
    in the texts of target with that in docs; weight is the mean gain of a document, rounded down
    (without features 0). score adds Gumbel noise drawn by seed and doc_id (null: as an empty
    string). Of the documents with at least least_words words, per_cent hundredths, rounded down,
    with the highest scores are drawn: rank counts them from 1, ties going to smaller doc_ids (null
    last), then smaller weights and fewer features; the others have none.

    Null texts are empty. Rows that repeat are counted and drawn each by itself. An empty table gives
    no rows; without target texts gains compare with an even share. Other columns are ignored. Texts
    of more than size bytes are cut at word boundaries into chunks that own the words beginning in
    them and carry the next n - 1; chunks are dealt over tasks and added up by document, so that one
    very long text keeps no task. Only counts of buckets and, for ranks, ids and numbers are shuffled.
    """
    docs = docs.select("doc_id", "text")
    gain = gains(docs, target.select(F.lit(0).alias("doc_id"), "text"), n, buckets, size)
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    exact = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0).cast("long")
    rows = durable(weighed(docs, gain, n, size).withColumn("weight", exact).withColumn("score", F.col("weight") + noise))
    able = rows.where(F.col("n_words") >= least_words)
    most = able.count() * per_cent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").asc(), F.col("n_features").asc(), F.col("row").asc()]
    ranked = in_order(able.withColumn("row", F.monotonically_increasing_id()), order)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    out = ranked.select(*columns, F.when(F.col("place") <= most, F.col("place")).cast("long").alias("rank"))
    return out.unionByName(rows.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


RESAMPLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
u AS (SELECT doc_id, unnest(words) AS word FROM d),
c AS (SELECT word, {crc32_sql("word")} % {BUCKETS} AS bucket FROM (SELECT word FROM u UNION SELECT word FROM b)),
f AS (SELECT u.doc_id, c.bucket FROM u JOIN c USING (word)),
s AS (SELECT bucket, count(*) AS n FROM f GROUP BY bucket),
t AS (SELECT c.bucket, count(*) AS n FROM b JOIN c USING (word) GROUP BY c.bucket),
g AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM u) + {BUCKETS}) / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM b) + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t ON t.bucket = s.bucket),
w AS (SELECT f.doc_id, count(*) AS n, sum(g.gain)::BIGINT AS total FROM f JOIN g USING (bucket) GROUP BY f.doc_id),
x AS (
  SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(w.n, 0) AS n_features,
         CASE WHEN w.n > 0 THEN ((w.total - ((w.total % w.n) + w.n) % w.n) // w.n)::BIGINT ELSE 0 END AS weight,
         floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || d.doc_id)[:8])::BIGINT + 0.5)::DOUBLE / 4294967296.0)))::BIGINT AS noise
  FROM d LEFT JOIN w ON w.doc_id = d.doc_id),
r AS (
  SELECT *, weight + noise AS score, n_words >= {LEAST_WORDS} AS able,
         row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY weight + noise DESC, doc_id) AS place FROM x)
SELECT doc_id, n_words, n_features, weight, score,
       CASE WHEN able AND place <= (SELECT count(*) FROM x WHERE n_words >= {LEAST_WORDS}) * {PER_CENT} // 100 THEN place END AS rank
FROM r
"""
