"""The ranking against a plain logistic loss, over odd texts, and over labels that it has not seen."""

import numpy as np
import pytest
from test_text_operators import rows

from rasterfold.llm import quality
from rasterfold.llm.common import table


def test_weights_are_those_of_the_loss():
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(0.4, 1, (60, 3)), draw.normal(-0.4, 1, (50, 3))])
    good = np.arange(110) < 60
    ranker = quality.train(x, good, pairs=400, seed=3)
    again = np.random.default_rng(3)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    difference = z[again.choice(np.flatnonzero(good), 400)] - z[again.choice(np.flatnonzero(~good), 400)]
    weights = np.zeros(3)
    for _ in range(20_000):  # plain gradient descent
        p = 1 / (1 + np.exp(difference @ weights))
        weights += 0.05 * (difference.T @ p / 400 - 1e-3 * weights)
    assert np.allclose(ranker.weights, weights, atol=1e-4)
    cut = np.sort(ranker.raw(x))
    wrong = lambda c: (ranker.raw(x[good]) < c).sum() + (ranker.raw(x[~good]) >= c).sum()
    threshold = np.log(quality.ACCEPT / (1 - quality.ACCEPT)) - ranker.offset
    assert wrong(threshold) == min(wrong(c) for c in [*cut, cut[-1] + 1])


def test_held_out_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows(quality.classify(docs, labels)) if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 20 and np.mean([p == t for p, t in held]) >= 0.9


def test_odd_texts(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (8, 0, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows(quality.classify(odd_docs, labels))
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got) and score[1] == score[2]
    assert len({r["score"] for r in got if r["doc_id"] == 6}) == 1


def test_repeated_ids_are_collected_once(spark, make_docs):
    docs = make_docs([(1, "a b c")] * 50 + [(2, "! ! !")] * 50)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    once = quality.fit(make_docs([(1, "a b c"), (2, "! ! !")]), labels)
    assert quality.fit(docs, labels).offset == pytest.approx(once.offset)
