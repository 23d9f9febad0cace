"""Stages over columns with the names that operators use inside, over ties, and over rows without ids or with one id."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rasterfold.llm import exact, mixing, substrings

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
NAMES = ("_id", "_sha", "_copies", "_text_id", "_source", "_words", "_begins", "_row", "_take", "_size", "_key", "_digest", "nth", "doc", "fp", "best", "n", "norm", "row", "drawn", "tie", "taken", "rest", "passes", "stream", "take", "times", "with.dot", "with space")


@pytest.fixture(scope="module")
def clashing(make_docs):
    docs = make_docs([(i % 40 if i % 7 else None, f"some words of text {i % 30} " * (1 + i % 4), f"s{i % 3}") for i in range(120)])
    for k, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.lit(k))
    return docs


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_clashing_names(spark, clashing, name):
    got = STAGES[name](spark, clashing, SF)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in rows) and (rows or name == "quality")


def test_passages_with_clashing_names(clashing):
    assert substrings.repeated_passages(clashing).count() == clashing.count()
    assert substrings.without_repeats(clashing).columns == clashing.columns


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i % 3])
def test_rows_that_share_an_id_give_their_target(make_docs, ids):
    docs = make_docs([(ids(i), f"w{i} " * 10, "a") for i in range(1000)] + [(5000 + i, "x " * 20, f"b{i % 4}") for i in range(40)])
    mix = mixing.mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    words = {r["source"]: r["n"] for r in mixing.mixed(docs).groupBy("source").agg(F.sum(mixing.n_words()).alias("n")).collect()}
    for r in mix:
        assert abs(r["taken"] - r["target"]) <= 1 + r["target"] / 64 and words[r["source"]] == r["taken"]


def test_equal_rows_are_taken_each_by_itself(make_docs):
    docs = make_docs([(1, "one two three", "a")] * 300 + [(2, "four five six", "b")] * 3)
    taken = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    words = Counter()
    for r in mixing.mixed(docs).collect():
        words[r["source"]] += len(r["text"].split())
    assert words == {r["source"]: r["n"] for r in taken}


def test_ties_are_settled_by_the_whole_row(make_docs, spark):
    rows = [(1, "a b  c", s) for s in "zyx"] + [(1, "a  b c", s) for s in "wv"]
    kept = [Counter(tuple(r) for r in STAGES[name](spark, make_docs(order).repartition(n), SF).collect()) for name in ("exact_dedup", "near_dedup") for order in (rows, rows[::-1]) for n in (1, 3)]
    assert all(sum(k.values()) == 1 for k in kept) and kept[0] == kept[1] == kept[2] == kept[3] and kept[4] == kept[5] == kept[6] == kept[7]


def test_texts_behind_one_hash_stay_apart(make_docs):
    docs = make_docs([(i, f"text {i % 5}") for i in range(20)])
    assert sorted(r["doc_id"] for r in exact.without_copies(docs, lambda sha: F.substring(sha, 1, 0)).collect()) == [0, 1, 2, 3, 4]
