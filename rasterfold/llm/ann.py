"""Approximate nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterfold.llm.common import durable

#: Hash tables, buckets of each that a query probes (of two for each dimension), pseudo-rotations.
TABLES, PROBES, ROUNDS, SEED = 12, 12, 3, 17
#: Points, and queries, of one bucket that a task compares at once; larger buckets are dealt over several.
BLOCK = 4096
#: Pairs that are scored exactly at once.
_PAIRS = 1 << 16


def _dimension(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def rotations(n: int, tables: int = TABLES, polytopes: int = 1, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Random signs for each table, polytope and round."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, polytopes, rounds, _dimension(n)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    size, h = x.shape[1], 1
    while h < size:
        y = x.reshape(len(x), size // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), size)
        h *= 2
    return x / np.sqrt(size)


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Each row after rounds of random signs and Hadamard transforms, filled up with zeros to a power of two."""
    x = np.pad(x, ((0, 0), (0, signs.shape[1] - x.shape[1])))
    for s in signs:
        x = hadamard(x * s)
    return x


def probes(x: np.ndarray, signs: np.ndarray, count: int) -> np.ndarray:
    """The nearest count buckets of each row, nearest first.

    A bucket is a signed axis of each polytope (axis i is 2 i, its opposite 2 i + 1), the nearer the
    larger the sum of the row's coordinates along them is.
    """
    codes, sums = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for s in signs:
        y = rotated(x, s)
        both = np.stack((y, -y), 2).reshape(len(y), -1)
        axes = np.argsort(-both, axis=1, kind="stable")[:, :count]
        total = (sums[:, :, None] + np.take_along_axis(both, axes, 1)[:, None, :]).reshape(len(x), -1)
        code = (codes[:, :, None] * both.shape[1] + axes[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-total, axis=1, kind="stable")[:, :count]
        codes, sums = np.take_along_axis(code, order, 1), np.take_along_axis(total, order, 1)
    return codes


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)


def usable(column: str = "embedding") -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _hashed(rows: DataFrame, signs: np.ndarray, count: int, role: int) -> DataFrame:
    """place (table and bucket), role, id, vector for each row of (id, vector) and each bucket it is in."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.iloc[at : at + 1024]
                x = _matrix(batch["vector"])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                for t, of_table in enumerate(signs):
                    buckets = probes(x, of_table, count)
                    row = np.repeat(np.arange(len(batch)), buckets.shape[1])
                    yield pd.DataFrame({"place": buckets.ravel() * len(signs) + t, "id": batch["id"].to_numpy()[row], "vector": batch["vector"].to_numpy()[row]})

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("id", "vector").mapInPandas(hashed, f"place long, id long, vector {kind}").withColumn("role", F.lit(role))


def _best(queries: pd.DataFrame, points: pd.DataFrame, most: int) -> pd.DataFrame:
    """Of each query the nearest points here, ties to smaller ids, with scores summed in one order whatever else is here.

    The matrix product only says which points may be among them; all within its rounding of the
    last place are scored exactly, so no tie is cut by chance.
    """
    q, p = _matrix(queries["vector"]), _matrix(points["vector"])
    near = q @ p.T
    if near.shape[1] > most:
        last = -np.partition(-near, most - 1, axis=1)[:, most - 1 : most]
        slack = 1e-12 * q.shape[1] * np.linalg.norm(q, axis=1, keepdims=True) * np.linalg.norm(p, axis=1).max()
        row, column = np.nonzero(near >= last - slack)
    else:
        row, column = (x.ravel() for x in np.indices(near.shape))
    exact = np.concatenate([(q[row[at : at + _PAIRS]] * p[column[at : at + _PAIRS]]).sum(1) for at in range(0, len(row), _PAIRS)])
    ids = points["id"].to_numpy()[column]
    order = np.lexsort((ids, -exact, row))
    row = row[order]
    begin = np.searchsorted(row, row)
    kept = np.arange(len(row)) - begin < most
    order, row = order[kept], row[kept]
    return pd.DataFrame({"query": queries["id"].to_numpy()[row], "id": ids[order], "score": exact[order]})


def _candidates(points: DataFrame, queries: DataFrame, signs: np.ndarray, count: int, most: int, block: int) -> DataFrame:
    """query, id, score: of each query and bucket the best most of the points there.

    The points of a bucket are dealt over blocks, and the queries too; every block of one meets
    every block of the other in a task of its own. There is a row of sizes for each table and
    bucket, a number that the parameters bound, so sizes are broadcast.
    """
    index, asked = _hashed(points, signs, 1, 1), _hashed(queries, signs, count, 0)
    both = index.select("place", "role").unionByName(asked.select("place", "role")).groupBy("place").agg(F.count_if(F.col("role") == 1).alias("n_points"), F.count_if(F.col("role") == 0).alias("n_queries"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = F.broadcast(durable(both.where("n_points > 0 and n_queries > 0").select("place", blocks("n_points").alias("blocks"), blocks("n_queries").alias("askers"))))
    every = "explode(sequence(0, {} - 1))"
    index = index.join(sizes, "place").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("asker", F.expr(every.format("askers")))
    asked = asked.join(sizes, "place").withColumn("asker", F.pmod(F.xxhash64("id"), F.col("askers")).cast("int")).withColumn("block", F.expr(every.format("blocks")))
    rows = index.unionByName(asked).drop("blocks", "askers").repartition("place", "block", "asker").sortWithinPartitions("place", "block", "asker", "role", "id")

    def answered(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        asking = group["role"].to_numpy() == 0
        p, q = group[~asking], group[asking]
        for at in range(0, len(q) if len(p) else 0, 1024):
            yield _best(q.iloc[at : at + 1024], p, most)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            batch = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            if not len(batch):
                continue
            keys = batch[["place", "block", "asker"]].to_numpy()
            edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for a, b in zip(edge, edge[1:], strict=False):
                yield from answered(batch.iloc[a:b])
            kept = batch.iloc[edge[-1] :]
        if kept is not None:
            yield from answered(kept)

    return rows.mapInPandas(compared, "query long, id long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, tables: int = TABLES, count: int = PROBES, block: int = BLOCK, polytopes: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, by inner product.

    vectors has vec_id and embedding; queries picks the rows that ask, and all rows but itself may
    answer. Unit vectors are hashed: in each table random signs and Hadamard transforms turn them,
    and the nearest signed axis is the bucket, or that of several rotations (polytopes) together: a
    table has (2 dimensions) ** polytopes buckets, so more polytopes let a query meet a smaller
    share of the points, and ask for more probes. A query looks into the buckets of its nearest
    axes in each table, and what it finds is ranked by the exact inner product of the original vectors
    in double precision, ties to the smaller id. Queries that find fewer than k look into all
    buckets of a table, so the result has k rows for each whenever there are so many.

    Null, zero and non-finite vectors take no part; vectors of another length than most (of equally
    many the shorter) neither. Equal vectors are one point of the index with its k + 1 smallest ids, and equal
    queries ask once, so copies cost no pairs. Buckets are compared in blocks of a bounded number
    of points and queries; no task holds more of them. Rows that repeat an id and vector count once. An empty
    table gives no rows; other columns are ignored.
    """
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").alias("vector"), queries.alias("asks"))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = common["n"] if common else 1
    rows = rows.where(F.size("vector") == n)
    smallest = rows.select("vector", "vec_id").distinct().withColumn("r", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    points = durable(smallest.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("id", F.col("ids")[0]))
    asking = rows.where("asks").select("vector", F.col("vec_id").alias("query_id")).distinct()
    asking = durable(asking.join(points.select("vector", F.col("id").alias("query")), "vector").select("query_id", "query", "vector"))
    queries_of = asking.groupBy("query").agg(F.first("vector").alias("vector")).select(F.col("query").alias("id"), "vector")

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("query", "id").agg(F.max("score").alias("score"))
        order = W.partitionBy("query").orderBy(F.desc("score"), "id")
        return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")

    found = durable(ranked(_candidates(points, queries_of, rotations(n, tables, polytopes), count, k + 1, block)))
    weights = points.select("id", F.size("ids").alias("members"))
    enough = found.join(weights, "id").groupBy("query").agg(F.sum("members").alias("members")).where(F.col("members") > k)
    short = durable(queries_of.join(enough, queries_of["id"] == enough["query"], "left_anti"))
    if not short.isEmpty():
        found = ranked(found.unionByName(_candidates(points, short, rotations(n, 1), 2 * _dimension(n), k + 1, block)))
    each = found.join(points.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
    answers = asking.select("query_id", "query").join(each, "query").where("vec_id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
