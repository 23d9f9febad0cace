"""Joins that deal hot keys give what plain joins give, and hot groups go through all operators that use them."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_simhash, rows

from rasterfold.llm import common, exact, simhash


def test_against_a_plain_join(spark):
    facts = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 3).alias("n"), F.col("id").cast("string").alias("fact"))
    data = spark.range(5000).select((F.col("id") % 50).alias("k"), "id")
    want = Counter(map(tuple, data.join(facts, "k").select("k", "id", "n", "fact").collect()))
    for hot in (1, 60, 10_000):
        assert Counter(map(tuple, common.join_spread(data, facts, "k", "n", "id", hot, 16).select("k", "id", "n", "fact").collect())) == want


def test_hot_groups(make_docs):
    docs = make_docs([(i, "one text of many copies") for i in range(60)] + [(None, "one text of many copies"), (100, "another"), (101, " another")])
    plain, spread = (Counter(tuple(r[:5]) for r in exact.exact_groups(docs, hot_rows=n).collect()) for n in (10**6, 2))
    assert plain == spread and sum(plain.values()) == 63


@pytest.mark.parametrize("hot", [2, 1024])
def test_large_components(make_docs, monkeypatch, hot):
    monkeypatch.setattr(simhash, "join_spread", lambda *a: common.join_spread(*a[:5], hot, 8))
    base = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join([*base[: 150 + i % 40], "x", *base[150 + i % 40 :]])) for i in range(80)] + [(200, "quite another text of some words")]
    prints = {i: brute_simhash(t) for i, t in docs}
    root, least = brute_components(prints.values()), {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    got = {r["doc_id"]: r["component_id"] for r in rows(simhash.near_duplicates(make_docs(docs)))}
    assert got == {i: least[root[p]] for i, p in prints.items()}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = getConf = lambda self: None

    class Conf(dict):
        pass

    context = Context()
    context.getConf = Conf
    frame = type("Frame", (), {"sparkSession": type("Session", (), {"sparkContext": context})()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.durable(frame)
