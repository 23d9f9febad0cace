"""Toxicity: the noisy-or's slope against differences, spans, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterfold.llm import registry, toxicity
from rasterfold.llm.toxicity import Bags, Detector, noisy_or, sentences, train


def test_noisy_or():
    assert noisy_or(np.zeros(0)) == 0
    assert noisy_or(np.array([0.1, 0.2, 0.5])) == pytest.approx(1 - 0.9 * 0.8 * 0.5)
    assert noisy_or(np.array([1e-12, 1e-12])) == pytest.approx(2e-12, rel=1e-6)


def loss(weights, bias, documents, quiet, toxic, penalty):
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    total = penalty * weights.sum()
    for d, q, y, k in zip(documents, quiet, toxic, share, strict=True):
        z = np.array([bias + weights[b].sum() for b, n in d for _ in range(n)] + [bias] * int(q))
        clean = -np.logaddexp(0, z).sum()
        total -= k * (np.log(-np.expm1(clean)) if y else clean)
    return total


def test_training_goes_to_the_least_loss():
    draw = np.random.default_rng(4)
    documents, toxic = [], draw.random(60) < 0.3
    for y in toxic:
        documents.append([(draw.choice(6, 2, replace=False) if not (y and k == 0) else np.array([0, 3]), int(draw.integers(1, 3))) for k in range(3)])
    quiet = draw.integers(0, 5, 60).astype(float)
    bags = Bags(
        np.concatenate([b for d in documents for b, _ in d]), np.array([len(b) for d in documents for b, _ in d]), np.array([float(n) for d in documents for _, n in d]),
        np.repeat(np.arange(60), 3), quiet, toxic,
    )
    found = train(bags, list("012345"), steps=3000, penalty=1e-3)
    at = np.array([found.weights.get(str(i), 0.0) for i in range(6)])
    best = loss(at, found.bias, documents, quiet, toxic, 1e-3)
    for i in range(6):
        for step in (-0.05, 0.05):
            moved = at.copy()
            moved[i] = max(0, at[i] + step)
            assert loss(moved, found.bias, documents, quiet, toxic, 1e-3) >= best - 1e-6
    for step in (-0.05, 0.05):
        assert found.bias + step > -4 or loss(at, found.bias + step, documents, quiet, toxic, 1e-3) >= best - 1e-6


def test_sentences_have_all_words_once():
    text = "One two. Three!\nfour five\n\n... 12 ... six" + " seven" * 100
    found = list(sentences(text))
    assert [w for _, _, words in found for w in words] == ["One", "two", "Three", "four", "five", "six"] + ["seven"] * 100
    assert all(a < b for a, b, _ in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    assert text[found[0][0] : found[0][1]] == "One two." and text[found[1][0] : found[1][1]].strip() == "Three!"
    assert max(len(words) for _, _, words in found) == toxicity.LONGEST


def test_long_clean_texts_stay_clean_and_one_sentence_is_found(make_docs):
    rude = {"=grobian": 14.0}
    detector = Detector(rude, -10.0)
    clean = "Plain words of a text. " * 3000
    docs = make_docs([(1, clean), (2, clean + "You GROBIAN there! " + clean), (3, None), (4, "İ grobian. Ok."), (None, "grobian")])
    got = {r["doc_id"]: r for r in toxicity.scored(docs, detector).collect()}
    assert got[1]["score"] < 0.2 and got[2]["score"] > 0.9 and got[3]["score"] == 0 and got[3]["n_sentences"] == 0 and got[4]["score"] > 0.9
    spans = {r["doc_id"]: r for r in toxicity.offending_sentences(docs, detector).collect()}
    assert spans[2]["sentence"].strip() == "You GROBIAN there!" and spans[4]["sentence"] == "İ grobian." and set(spans) == {2, 4, None}


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = registry.op11_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r["toxic"] == r["predicted"] for r in found]
    clean = [r["predicted"] for r in found if r["toxic"] == 0]
    assert sum(right) / len(right) > 0.93 and sum(clean) / len(clean) < 0.03
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in found)


def test_nothing_is_learnt_of_held_out_rows(make_docs, spark):
    ids = range(60)
    docs = make_docs([(i, "a pest of a text" if i % 2 else "a good text") for i in ids])
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in held], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels).weights == {}


def test_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (6, 1, 1), (8, 1, None), (None, 0, 1), (9, 5, 7), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert toxicity.toxicity(no_docs, labels).count() == 0 and toxicity.toxicity(odd_docs, labels.where(F.lit(False))).count() == odd_docs.count()
