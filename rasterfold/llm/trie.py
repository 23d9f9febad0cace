"""A prefix trie of conversations: owned chains found by binary search, added up from the leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.llm.common import crc32_sql, durable, join_spread, running, text_of

#: Neighbours of GROUP consecutive ids share the first turns of the first of them: crc32(id) % SHARED turns.
GROUP, SHARED = 100, 6
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _half(sha256: Column, n: int) -> Column:
    """64 of the bits of a hexadecimal SHA-256 as a signed integer."""
    high, low = (F.conv(F.substring(sha256, 16 * n + 1 + k, 8), 16, 10).cast("long") for k in (0, 8))
    return F.shiftleft(high, 32).bitwiseOR(low)


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of each rebuilt conversation, and its turns (conv_id, depth from 1, content, n_code)."""
    content = F.sha2(F.concat(F.sha2(text_of("role"), 256), text_of()), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text_of("role").alias("role"), content.alias("content"), F.char_length(text_of()).cast("long").alias("n_code"))
    turns = durable(running(durable(rows), "conv_id", [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("content").asc()]).select("conv_id", "at", "content", "n_code"))
    counts = durable(turns.groupBy("conv_id").agg(F.count("*").alias("own")))
    shared = F.col("conv_id") - F.col("conv_id") % GROUP
    wanted = counts.select("conv_id", "own", shared.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"))
    firsts = turns.where(F.col("at") < SHARED).select(F.col("conv_id").alias("base"), "at", "content", "n_code")
    had = counts.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = wanted.join(had, "base", "left").withColumn("given", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = durable(convs.select("conv_id", "base", "h", "given", "own", (F.col("given") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")))
    first = convs.join(firsts, "base").where("at <= h").select("conv_id", F.col("at").alias("depth"), "content", "n_code")
    own = join_spread(turns, convs.select("conv_id", "h", "given", "own"), "conv_id", "own", "at").where("at > h")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("given")).alias("depth"), "content", "n_code")
    return convs.select("conv_id", "length"), durable(first.unionByName(own))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node, n_code: node is a digest of depth and of all turns up to it.

    Each turn is hashed with its depth; the exclusive or of these (128 bits) tells sequences of one depth apart.
    """
    placed = turns.withColumn("placed", F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("content")), 256))
    halves = placed.select("conv_id", "depth", "n_code", _half(F.col("placed"), 0).alias("a"), _half(F.col("placed"), 1).alias("b"))
    summed = running(halves, "conv_id", [F.col("depth").asc()], x="bit_xor(a)", y="bit_xor(b)")
    return summed.select("conv_id", "depth", F.concat_ws(":", *(F.col(c).cast("string") for c in ("depth", "x", "y"))).alias("node"), "n_code")


def first_owned(convs: DataFrame, paths: DataFrame, minima: DataFrame) -> DataFrame:
    """conv_id, length, first: the first depth of which the conversation is the smallest member (length + 1: none).

    A conversation that owns a depth owns all deeper ones, so a binary search finds the first:
    every round looks up the prefix in the middle of what is left of each conversation.
    """
    search = durable(convs.select("conv_id", "length", F.lit(1).cast("long").alias("low"), (F.col("length") + 1).alias("high")))
    found = []
    while True:
        found.append(search.where("low >= high").select("conv_id", "length", F.col("low").alias("first")))
        search = search.where("low < high").withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2).cast("long"))
        if search.isEmpty():
            break
        middle = search.join(paths.select("conv_id", "depth", "node"), ["conv_id", "depth"])
        judged = join_spread(middle, minima.select("node", "owner", "n_convs"), "node", "n_convs", "conv_id")
        owned = F.col("owner") == F.col("conv_id")
        search = durable(judged.select("conv_id", "length", F.when(owned, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owned, F.col("depth")).otherwise(F.col("high")).alias("high")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return durable(out)


def chain_totals(chains: DataFrame) -> DataFrame:
    """conv_id, parent, above, leaves, saved: chains (conv_id, parent, above, saved) with the sums over all chains below.

    Bottom-up: a chain is done when those that hang on it are; every round settles the chains that
    nothing open hangs on and goes on with the others. There are as many rounds as chains hang
    under one another, at most the turns of the longest conversation.
    leaves counts a chain's own end if nothing hangs there, which the column own_leaf says.
    """
    left = durable(chains.select("conv_id", "parent", "above", F.col("own_leaf").cast("long").alias("leaves"), "saved"))
    done = []
    while not left.isEmpty():
        parents = left.where("parent is not null").select(F.col("parent").alias("conv_id")).distinct()
        ready = durable(left.join(parents, "conv_id", "left_anti"))
        done.append(ready)
        sums = ready.groupBy(F.col("parent").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        rest = left.join(parents, "conv_id", "left_semi").join(sums, "conv_id", "left")
        left = durable(rest.select("conv_id", "parent", "above", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved"))))
    out = done[0] if done else left
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal (owner, depth) in a batch as one row: the smallest id and all ids, joined by commas."""
    for batch in batches:
        rows: list[list] = []
        for owner, depth, conv in zip(*(batch[c].to_pylist() for c in ("owner", "depth", "conv_id")), strict=True):
            if rows and rows[-1][:2] == [owner, depth]:
                rows[-1][3].append(str(conv))
            else:
                rows.append([owner, depth, conv, [str(conv)]])
        owner, depth, least, ids = zip(*rows, strict=True) if rows else ((),) * 4
        longs = [pa.array(c, pa.int64()) for c in (owner, depth, least)]
        yield pa.RecordBatch.from_arrays([*longs, pa.array(map(",".join, ids), pa.string())], ["owner", "depth", "least", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each (owner, depth), as the sorted pieces stream by."""

    def out(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        owner, depth, digest = zip(*rows, strict=True) if rows else ((),) * 3
        return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())], ["owner", "depth", "ends_sha256"])

    key, state = None, None
    for batch in batches:
        rows = []
        for owner, depth, ids in zip(*(batch[c].to_pylist() for c in ("owner", "depth", "ids")), strict=True):
            if key == (owner, depth):
                state.update(b"," + ids.encode())
                continue
            if key:
                rows.append((*key, state.hexdigest()))
            key, state = (owner, depth), hashlib.sha256(ids.encode())
        yield out(rows)
    yield out([(*key, state.hexdigest())] if key else [])


def ends_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 of ends (owner, depth, conv_id): the ids in ascending order, joined by commas.

    Ids are sorted in ranges, where those of one node become a row for each batch; only these rows
    meet, and are hashed one after the other as they stream by.
    """
    sorted_ends = ends.repartitionByRange("owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id")
    pieces = sorted_ends.mapInArrow(_pieces, "owner long, depth long, least long, ids string")
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "least").mapInArrow(_digests, "owner long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns (conv_id, turn, role, text) are ordered by turn, null first, then role, then the SHA-256
    of the text; null roles and texts are empty. Conversation c begins with the first crc32(c) % 6
    turns of c - c % 100 (division towards zero, as in SQL), in place of as many of its own. Rows
    without conv_id belong to no conversation and are left out. Rows that repeat are turns each. A
    node is a distinct sequence of first turns and has the smallest conversation with it as its
    name; the root has depth 0 and no parent. An empty table gives no rows; other columns are
    ignored; texts of any length are hashed whole and never shuffled.

    Every conversation owns the nodes from some depth on (none, if a smaller one has all its turns):
    its chain, which hangs on a node of another's. The first owned depth is found by binary search
    against the smallest member of each prefix; sums go up chain by chain, and within a chain as
    running sums. Prefixes are told apart by 128 bits. Hot prefixes are dealt over many tasks, long
    conversations are cut into ranges.
    """
    convs, turns = rebuilt_turns(conversations)
    paths = durable(prefixes(turns))
    minima = durable(paths.groupBy("depth", "node").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("n_code").alias("n_code")))
    all_convs = convs.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 0")
    least = (all_convs.first() or {"owner": None})["owner"]
    owned = first_owned(convs, paths, minima)

    # Where each chain hangs: the owner of the prefix before the first owned depth (of the root, at depth 0).
    above = owned.withColumn("depth", F.col("first") - 1)
    deep = above.where("depth > 0").join(paths.select("conv_id", "depth", "node"), ["conv_id", "depth"])
    deep = join_spread(deep, minima.select("node", "owner", "n_convs"), "node", "n_convs", "conv_id")
    columns = ["conv_id", "length", "first", F.col("depth").alias("above")]
    hung = durable(deep.select(*columns, F.col("owner").alias("parent")).unionByName(above.where("depth <= 0").select(*columns, F.lit(least).cast("long").alias("parent"))))
    is_root = F.col("conv_id") == F.lit(least)
    chains = hung.where((F.col("first") <= F.col("length")) | is_root).select("conv_id", "length", F.when(is_root, 0).otherwise(F.col("first")).cast("long").alias("first"), F.when(~is_root, F.col("above")).alias("above"), F.when(~is_root, F.col("parent")).alias("parent"))
    ends = hung.select(F.when(F.col("first") > F.col("length"), F.col("parent")).otherwise(F.col("conv_id")).alias("owner"), F.col("length").alias("depth"), "conv_id")

    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("n_code")).alias("value"))
    nodes = nodes.unionByName(all_convs.select(F.col("owner").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("value")))
    hanging = chains.where("parent is not null").select(F.col("parent").alias("conv_id"), F.col("above").alias("depth"))
    hanging_at = hanging.groupBy("conv_id", "depth").agg(F.count("*").alias("hanging"))
    chains = chains.join(hanging_at.withColumnRenamed("depth", "length"), ["conv_id", "length"], "left").withColumn("own_leaf", F.col("hanging").isNull())
    values = nodes.groupBy("conv_id").agg(F.sum("value").alias("saved"))
    chains = durable(chains.join(values, "conv_id").select("conv_id", "length", "first", "above", "parent", "own_leaf", "saved"))
    totals = chain_totals(chains).where("parent is not null")

    # Facts about nodes: what hangs on them, where chains begin and end, which conversations end there.
    def fact(frame: DataFrame, **columns: Column) -> DataFrame:
        kinds = {"hanging": "long", "leaves": "long", "saved": "long", "start": "boolean", "stop": "boolean", "parent": "long", "ends_sha256": "string"}
        return frame.select("conv_id", "depth", *(columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))

    facts = fact(totals.select(F.col("parent").alias("conv_id"), F.col("above").alias("depth"), "leaves", "saved"), hanging=F.lit(1), leaves=F.col("leaves"), saved=F.col("saved"))
    facts = facts.unionByName(fact(chains.withColumn("depth", F.col("first")), start=F.lit(True), parent=F.col("parent")))
    facts = facts.unionByName(fact(chains.withColumn("depth", F.col("length")), stop=F.lit(True), leaves=F.col("own_leaf").cast("long")))
    facts = facts.unionByName(fact(ends_digests(ends).withColumnRenamed("owner", "conv_id"), ends_sha256=F.col("ends_sha256")))
    facts = facts.groupBy("conv_id", "depth").agg(F.sum("hanging").alias("hanging"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("start").alias("start"), F.max("stop").alias("stop"), F.max("parent").alias("parent"), F.max("ends_sha256").alias("ends_sha256"))
    zero = F.lit(0).cast("long")
    known = nodes.join(facts, ["conv_id", "depth"], "left")
    known = known.select(
        "conv_id", "depth", F.when(F.col("start").isNull(), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("hanging", zero) + F.when(F.col("stop").isNull(), 1).otherwise(0)).alias("n_children"),
        F.coalesce("leaves", zero).alias("leaves"), (F.col("value") + F.coalesce("saved", zero)).alias("saved"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )
    summed = running(known, "conv_id", [F.col("depth").desc()], n_leaves="sum(leaves)", saved_tokens="sum(saved)")
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")




TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, sha256(sha256(coalesce(role, '')) || coalesce(text, '')) AS x, length(coalesce(text, '')) AS v,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(sha256(coalesce(role, '')) || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, count(*) AS own FROM t GROUP BY c),
k AS (SELECT o.c, o.c - o.c % {GROUP} AS base, {crc32_sql("o.c::VARCHAR")} % {SHARED} AS h FROM o),
g AS (SELECT k.*, least(h, coalesce(b.own, 0)) AS given FROM k LEFT JOIN o b ON b.c = k.base),
r AS (
  SELECT g.c, t.n AS d, x, v FROM g JOIN t ON t.c = g.base AND t.n <= g.h
  UNION ALL SELECT g.c, t.n - g.h + g.given, x, v FROM g JOIN t ON t.c = g.c AND t.n > g.h),
p AS (
  SELECT c, d, v, sha256(string_agg(x, '') OVER (PARTITION BY c ORDER BY d)) AS path FROM r
  UNION ALL SELECT c, 0, 0, '' FROM g),
m AS (SELECT d, path, min(c) AS owner, count(*) AS n, max(v) AS v FROM p GROUP BY d, path),
w AS (SELECT p.c, p.d, m.owner FROM p JOIN m ON m.d = p.d AND m.path = p.path),
l AS (SELECT c, max(d) AS d FROM p GROUP BY c),
e AS (SELECT w.owner, w.d, string_agg(l.c::VARCHAR, ',' ORDER BY l.c) AS ids FROM l JOIN w ON w.c = l.c AND w.d = l.d GROUP BY w.owner, w.d),
u AS (SELECT m.owner, m.d, m.n, (m.n - 1) * m.v AS saved, w.owner AS parent FROM m LEFT JOIN w ON w.c = m.owner AND w.d = m.d - 1),
f AS (SELECT parent, d - 1 AS d, count(*) AS n FROM u WHERE d > 0 GROUP BY parent, d),
s AS (
  SELECT w.owner, w.d, sum(u.saved) AS saved, count(*) FILTER (f.n IS NULL) AS leaves
  FROM u LEFT JOIN f ON f.parent = u.owner AND f.d = u.d JOIN w ON w.c = u.owner AND w.d <= u.d GROUP BY w.owner, w.d)
SELECT u.owner AS conv_id, u.d AS depth, u.parent AS parent_conv_id, u.n AS n_convs, coalesce(f.n, 0) AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM u JOIN s ON s.owner = u.owner AND s.d = u.d LEFT JOIN f ON f.parent = u.owner AND f.d = u.d LEFT JOIN e ON e.owner = u.owner AND e.d = u.d
"""
