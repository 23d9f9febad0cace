"""SimHash near-duplicates, found by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rasterfold.llm.common import durable, join_spread, kept, numbered, text_of
from rasterfold.llm.components import components

SHINGLE, HASH_SEED, MOST_BITS = 4, 42, 4
#: First bit and length of each segment. Fingerprints that differ in at most 4 bits differ in at
#: most one bit of some of three segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of one signature that are compared in one piece; more are cut into such pieces.
PIECE = 4096
_KEY_BITS = 22
_SMALL = 16


def simhash(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only, as the contract has it
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: 1 - SHINGLE].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begins), 1 << 16):
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(begins[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((simhash(t) for t in texts), np.uint64, len(texts)).view(np.int64))


def _forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that is connected among these fingerprints, at most one less than there are."""
    left, a, b = np.arange(len(prints)), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(prints[left] ^ prints[i]) <= MOST_BITS
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), prints[i]))
                b.append(prints[found])
                todo.extend(found)
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _own_key(x: np.ndarray) -> np.ndarray:
    """The wildcard bit of the one signature under which a pair with this difference counts."""
    bit = np.full(len(x), -1)
    for first, size in reversed(SEGMENTS):
        part = (x >> np.uint64(first)) & np.uint64((1 << size) - 1)
        few = np.bitwise_count(part) <= 1
        place = np.where(part == 0, 0, np.log2(np.maximum(part, 1)).astype(np.int64))
        bit = np.where(few, first + place, bit)
    return bit


def _within(keys: np.ndarray, pieces: np.ndarray, prints: np.ndarray) -> pd.DataFrame:
    """Links within runs of equal key and piece: pair by pair in small runs, a spanning forest in large ones."""
    edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (pieces[1:] != pieces[:-1]), True])
    sizes = np.diff(edge)
    run = np.repeat(np.arange(len(sizes)), sizes)
    small = sizes[run] <= _SMALL
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    k, r, f = keys[small], run[small], prints[small]
    for gap in range(1, _SMALL):
        at = np.flatnonzero(r[gap:] == r[:-gap])
        if not len(at):
            break
        x = f[at] ^ f[at + gap]
        at = at[np.bitwise_count(x) <= MOST_BITS]
        at = at[_own_key(f[at] ^ f[at + gap]) == k[at] >> _KEY_BITS]
        a.append(f[at])
        b.append(f[at + gap])
    for i in np.flatnonzero(sizes > _SMALL):
        x, y = _forest(prints[edge[i] : edge[i + 1]])
        a.append(x)
        b.append(y)
    return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches are sorted by key and piece; a run that may go on in the next batch waits for it."""
    kept = None
    for batch in batches:
        batch = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        last = batch.iloc[-1] if len(batch) else None
        if last is None:
            continue
        going = ((batch["key"] == last["key"]) & (batch["piece"] == last["piece"])).to_numpy()
        kept, done = batch[going], batch[~going]
        yield _within(done["key"].to_numpy(), done["piece"].to_numpy(), done["fp"].to_numpy().view(np.uint64))
    if kept is not None:
        yield _within(kept["key"].to_numpy(), kept["piece"].to_numpy(), kept["fp"].to_numpy().view(np.uint64))


def _segment(k: int, value: Column) -> Column:
    first, size = SEGMENTS[k]
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << size) - 1))


def signatures(prints: DataFrame) -> DataFrame:
    """fp, key: each segment of fp with one bit wild, 64 rows for each fingerprint."""
    keys = [F.lit((first + i) << _KEY_BITS).bitwiseOR(_segment(k, F.col("fp")).bitwiseAND(F.lit(~(1 << i)))) for k, (first, size) in enumerate(SEGMENTS) for i in range(size)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(prints: DataFrame, piece: int = PIECE) -> DataFrame:
    """a, b: links between distinct fingerprints (long column fp) that differ in at most 4 bits.

    Not every pair is listed: among many that share a signature, enough links to connect what is
    connected. The rows of a signature are sorted and numbered (as they stream by, so in bounded
    memory); single ones go. The others are compared in pieces of a fixed size, so that no task
    holds more than two pieces however many share a signature; where there is more than one, every
    two pieces meet in a task of their own.
    """
    order = W.partitionBy("key").orderBy("fp")
    rows = signatures(prints).select("fp", "key", F.row_number().over(order).alias("n"), F.lead("fp").over(order).alias("next"))
    rows = rows.where("n > 1 or next is not null").select("key", F.floor((F.col("n") - 1) / piece).cast("int").alias("piece"), "fp")
    found = rows.mapInPandas(_linked, "a long, b long")
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _segment(k, F.col("fp")).alias("v")) for k in range(3))))
    if not prints.select(values.alias("s")).groupBy("s").count().where(F.col("count") > piece // 2).isEmpty():
        last = rows.where("piece > 0").groupBy("key").agg(F.max("piece").alias("last"))
        meet = rows.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).where("other != piece")
        meet = meet.select("key", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "fp")
        meet = meet.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp")
        pair = (F.col("low").cast("long") * (1 << 31) + F.col("high")).alias("piece")
        found = found.unionByName(meet.select("key", pair, "fp").mapInPandas(_linked, "a long, b long"))
    return found.distinct()


def _labelled(rows: DataFrame, piece: int) -> DataFrame:
    """fp, component, and the row best: of each distinct fingerprint in rows (fp, best), and the component that its links reach."""
    prints = durable(rows.groupBy("fp").agg(F.min("best").alias("best")))
    found = components(links(prints.select("fp"), piece))
    return prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "best", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hexadecimal digits), component_id.

    Words are runs of characters other than ASCII white space, A-Z lowered; shingles have four
    words, repeats included (a shorter text is one shingle; a text without words, null among them,
    has fingerprint zero). component_id is the smallest doc_id of all documents that chains of
    links reach, links being fingerprints that differ in at most 4 bits; null doc_ids link but
    don't count, so it is null where no other is. Rows that repeat are answered alike. An empty
    table gives no rows; other columns are ignored. Rows of one fingerprint, and fingerprints of
    one component, get their answers by joins that deal large groups over many tasks.
    """
    rows = durable(docs.select("doc_id", fingerprint(text_of()).alias("fp")))
    sizes = rows.groupBy("fp").agg(F.count("*").alias("n"))
    labelled = durable(_labelled(rows.select("fp", F.col("doc_id").alias("best")), piece))
    ids = durable(labelled.groupBy("component").agg(F.min("best").alias("component_id"), F.count("*").alias("prints")))
    named = join_spread(labelled, ids, "component", "prints", "fp").select("fp", "component_id")
    named = durable(named.join(sizes, "fp"))
    return join_spread(rows, named, "fp", "n", "doc_id").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of docs: of each component one, whatever ids are null or repeated.

    That is the smallest doc_id (null only where no other is); of rows that repeat this doc_id
    within the component, or have none, the longest text stays, then the smallest MD5 of it, then
    the smallest hash of all columns, so that reruns agree. Components without any id keep a
    document each, and so do components that share an id. Texts without words, null ones too, are
    near each other. An empty table gives no rows; texts of any length are read whole; other
    columns, whatever their names, stay as they are.

    Rows are numbered, and the texts meet the numbers that stay in one join.
    """
    rows = numbered(docs)
    text = text_of("doc.text")
    best = F.struct(F.col("doc.doc_id").isNull().alias("unnamed"), F.col("doc.doc_id").alias("doc_id"), (-F.char_length(text)).alias("shorter"), F.unhex(F.md5(text.cast("binary"))).alias("text_id"), F.xxhash64("doc").alias("row"), "nth")
    stay = _labelled(rows.select(fingerprint(text).alias("fp"), best.alias("best")), PIECE).groupBy("component").agg(F.min("best").alias("best"))
    return kept(rows, stay.select("best.nth"))
