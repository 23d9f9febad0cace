"""Connected components of a link table, by alternating stars in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterfold.llm.common import durable, join_spread


def _downward(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of node and neighbours, of which a node may have very many."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = durable(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    return join_spread(both, least, "a", "n", "b").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of links (long columns a, b).

    Rounds of large and small stars go on until nothing changes, a logarithmic number; each round
    is cut off by a checkpoint. Links with a null end or of a node to itself add nothing. An empty
    table gives no rows.
    """
    links = durable(_downward(links))
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        links = durable(_downward(_small_star(_downward(_large_star(links)))))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
