"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from labels of whole documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterfold.llm.common import durable, text_of

#: At most so many labelled documents are read for training.
SAMPLE = 20_000
#: A document counts as toxic, and a sentence as offending, from this score on.
TOXIC = 0.7
FOLDS, HELD = 3, 1
#: Of the features of training documents, at most so many get weights: those that speak most for toxic documents, in LEAST_DOCS of them or more.
KEPT, LEAST_DOCS, LEAST_Z = 4096, 2, 2.0
#: A sentence without sentence marks is cut after so many words.
LONGEST = 48
#: Lengths of the beginnings of words that are features beside the whole words.
BEGINS = (3, 4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?…。！？]+(?=\s|$)|\n")
#: Features that a task counts before it passes counts on.
_COUNTED = 1 << 18


def lowered(text: str) -> str:
    """The text in small letters, of unchanged length: the few letters that would become two stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def features_of(word: str) -> tuple[str, ...]:
    """A word ("=word") and its beginnings (their length and they)."""
    return (f"={word}", *(f"{k}{word[:k]}" for k in BEGINS if k <= len(word)))


def sentences(low: str) -> Iterator[tuple[int, int, list[str]]]:
    """start, end (code points) and words of each sentence with words in a lower-cased text.

    Sentences end with their marks before white space, or with a line; long ones are cut every
    LONGEST words. What follows the last word up to the next sentence belongs to it.
    """
    begin = 0
    for end in [*(m.end() for m in _SENTENCE.finditer(low)), len(low)]:
        words = _WORD.findall(low, begin, end)
        if 0 < len(words) <= LONGEST:
            yield begin, end, words
        elif words:
            places = [m.start() for m in _WORD.finditer(low, begin, end)][::LONGEST]
            for k, (a, b) in enumerate(zip(places, [*places[1:], end], strict=True)):
                yield a, b, words[k * LONGEST : (k + 1) * LONGEST]
        begin = end


@dataclass
class Detector:
    """A sentence's score is logistic(bias + weights of the features of its different words); a document's is the noisy-or of these."""

    weights: dict[str, float]
    bias: float
    heads: frozenset[str] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        self.heads = frozenset(f[1 : 1 + BEGINS[0]] for f in self.weights)

    def telling(self, words: set[str]) -> dict[str, float]:
        """Those of the words that have weight; words that begin like no feature are passed over."""
        heads, get = self.heads, self.weights.get
        likely = [w for w in words if w[: BEGINS[0]] in heads]
        return {w: v for w in likely if (v := sum(get(f, 0.0) for f in features_of(w)))}

    def of_sentences(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """start and end of each sentence, and their scores."""
        low = lowered(text)
        telling = self.telling(set(_WORD.findall(low)))
        found = list(sentences(low))
        z = np.full(len(found), self.bias)
        if telling:
            z += [sum(telling[w] for w in set(words) if w in telling) for _, _, words in found]
        return [(a, b) for a, b, _ in found], 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def noisy_or(scores: np.ndarray) -> float:
    """The chance that any sentence is toxic, taking them as independent; 0 without sentences."""
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum()))


@dataclass
class Bags:
    """Sentences with kept features, as flat arrays: those of one document are equal ones counted once.

    places (in kept) are those of all bags one after the other, lengths says how many each bag has,
    times how often it occurs in its document doc; quiet counts the other sentences of each document.
    """

    places: np.ndarray
    lengths: np.ndarray
    times: np.ndarray
    doc: np.ndarray
    quiet: np.ndarray
    toxic: np.ndarray


def train(bags: Bags, kept: list[str], steps: int = 400, penalty: float = 2e-4) -> Detector:
    """Weights (not below zero) of the kept features and a bias, by Adam on the noisy-or's log loss.

    Both classes count alike, however many documents they have. Without toxic documents all scores
    are near zero.
    """
    toxic, n = bags.toxic, len(bags.toxic)
    if not toxic.any():
        return Detector({}, -20.0)
    row = np.repeat(np.arange(len(bags.lengths)), bags.lengths)
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / max(1, (~toxic).sum()))
    theta = np.zeros(len(kept) + 1)
    theta[-1] = -6.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, bias = theta[:-1], theta[-1]
        z = bias + np.bincount(row, w[bags.places], len(bags.lengths))
        clean = np.bincount(bags.doc, -np.logaddexp(0, z) * bags.times, n) - bags.quiet * np.logaddexp(0, bias)
        pull = np.where(toxic, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-12), 1.0) * share
        of_z = pull[bags.doc] * bags.times / (1 + np.exp(-z))
        slope = np.r_[np.bincount(bags.places, of_z[row], len(kept)) + penalty, (pull * bags.quiet).sum() / (1 + np.exp(-bias)) + of_z.sum()]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        theta[:-1] = np.clip(theta[:-1], 0, 30)
        theta[-1] = min(theta[-1], -4.0)
    return Detector({kept[i]: float(theta[i]) for i in np.flatnonzero(theta[:-1] > 1e-3)}, float(theta[-1]))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learnt from: crc32 of doc_id as text, modulo 3, is 1 (null: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, toxic, clean: documents of either kind with the feature, added up as far as a task's memory is to go."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (counts[1], counts[0]))]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
            words = set(_WORD.findall(lowered(text.as_py())))
            counts[toxic].update(set(chain.from_iterable(map(features_of, words))))
            if len(counts[0]) + len(counts[1]) > _COUNTED:
                yield out()
    yield out()


def _bagged(kept: dict[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, toxic, quiet, places, lengths, times of each document, as in Bags."""
    heads = frozenset(f[1 : 1 + BEGINS[0]] for f in kept)

    def places(words: list[str]) -> tuple[int, ...]:
        return tuple(sorted(kept[f] for w in set(words) if w[: BEGINS[0]] in heads for f in features_of(w) if f in kept))

    for batch in batches:
        quiet, flat, lengths, times = [], [], [], []
        for text in batch["text"]:
            found = Counter(places(words) for _, _, words in sentences(lowered(text.as_py())))
            quiet.append(found.pop((), 0))
            bags = sorted(found.items())
            flat.append([i for b, _ in bags for i in b])
            lengths.append([len(b) for b, _ in bags])
            times.append([n for _, n in bags])
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(quiet, pa.int64()), *(pa.array(x, ints) for x in (flat, lengths, times))], ["doc_id", "toxic", "quiet", "places", "lengths", "times"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Detector:
    """A detector from a bounded sample of the labelled documents outside the held-out fold.

    The sample is the first rows by a hash of doc_id, one text for each id however often it is
    repeated. What speaks for toxicity is told by the numbers of toxic and of clean documents with a
    feature (the score of a test of equal shares); counts are added up by Spark, and only the kept
    features and the sampled sentences that have any reach the driver.
    """
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(taken), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = durable(rows.repartition("doc_id"))
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic:
        return Detector({}, -20.0)
    counts = rows.mapInArrow(_counted, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = (F.col("toxic") + F.col("clean") + 1) / F.lit(n_toxic + n_clean + 2.0)
    z = (F.col("toxic") / n_toxic - F.col("clean") / max(1, n_clean)) / F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / max(1, n_clean)))
    best = counts.withColumn("z", z).where((F.col("toxic") >= LEAST_DOCS) & (F.col("z") > LEAST_Z)).orderBy(F.desc("z"), "feature").limit(KEPT)
    kept = sorted(r["feature"] for r in best.select("feature").collect())
    places = {f: i for i, f in enumerate(kept)}
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(lambda batches: _bagged(places, batches), f"doc_id {kind}, toxic int, quiet long, places array<int>, lengths array<int>, times array<int>").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    flat = {c: found[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("places", "lengths", "times")}
    doc = np.repeat(np.arange(len(found)), found["lengths"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
    bags = Bags(flat["places"], flat["lengths"], flat["times"].astype(np.float64), doc, found["quiet"].to_numpy().astype(np.float64), found["toxic"].to_numpy() == 1)
    return train(bags, kept)


def scored(docs: DataFrame, detector: Detector, offending: float = TOXIC) -> DataFrame:
    """doc_id, score, n_sentences, offending (array of start, end, score of the sentences that offend) of each row of docs."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, numbers, spans = [], [], []
            for text in batch["text"]:
                places, p = detector.of_sentences(text.as_py())
                scores.append(noisy_or(p))
                numbers.append(len(p))
                spans.append([{"start": places[i][0], "end": places[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= offending)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64()), pa.array(numbers, pa.int64()), pa.array(spans, pa.list_(span))], ["doc_id", "score", "n_sentences", "offending"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(score, f"doc_id {kind}, score double, n_sentences long, offending array<struct<start: long, end: long, score: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted, n_sentences, offending.

    Labels (doc_id, toxic 0 or 1; other values and nulls are passed over) are learnt outside the
    held-out fold only. score is the noisy-or of the scores of all sentences of the whole text,
    however long; predicted is 1 from TOXIC on. offending lists start, end (code points, end
    exclusive) and score of each sentence that reaches TOXIC by itself, which a document of many
    doubtful sentences may lack. A null text counts as empty; texts without words score 0. Rows that
    repeat score alike; an empty table gives no rows; without toxic labels all scores are near 0.
    Other columns are never inputs of a score. Scoring is one pass without a shuffle.
    """
    out = scored(docs, fit(docs, labels, sample))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "n_sentences", "offending")


def offending_sentences(docs: DataFrame, detector: Detector, least: float = TOXIC) -> DataFrame:
    """One row per offending sentence of docs (doc_id, text): doc_id, start, end, score, sentence.

    Null and empty texts give no rows, nor does an empty table; rows that repeat are answered alike.
    """
    numbered = docs.select("doc_id", text_of().alias("text"))
    found = scored(numbered.select(F.struct("doc_id", "text").alias("doc_id"), "text"), detector, least)
    rows = found.select("doc_id", F.explode("offending").alias("s"))
    return rows.select("doc_id.doc_id", "s.start", "s.end", "s.score", F.expr("substring(doc_id.text, CAST(s.start AS INT) + 1, CAST(s.end - s.start AS INT))").alias("sentence"))
