"""Quality by Bradley-Terry ranking: scores learnt from pairs of a better and a worse document."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rasterfold.llm.common import text_of, whole_row

#: At most so many labelled rows are read for training, and so many pairs drawn from them.
SAMPLE, PAIRS, SEED = 20_000, 200_000, 7
#: A document is accepted from this score on; the learnt quantile of raw scores is moved here.
ACCEPT = 0.3
FOLDS = 5
_KINDS = np.full(256, 7, np.uint8)  # 7: bytes of letters beyond ASCII
_KINDS[:128] = 6  # symbols
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:'\"()-?")):
    _KINDS[list(_bytes)] = _k
_SENTENCE = re.compile(rb"[.!?]+\s")
FEATURES = (
    "log_words", "upper", "digits", "blanks", "lines", "marks", "symbols", "beyond_ascii", "bangs", "bars", "word_length", "distinct_words", "repeated_neighbours",
    "distinct_lines", "symbol_words", "upper_words", "common_share", "sentence_words", "short_words", "long_words",
)


def features(text: str) -> np.ndarray:
    """Figures of style, all of them shares or bounded: no vocabulary, no identifiers."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros(len(FEATURES))
    kinds = np.bincount(_KINDS[np.frombuffer(data, np.uint8)], minlength=8) / len(data)
    letters = max(1e-9, kinds[0] + kinds[1] + kinds[7])
    n, counts = len(words), pd.Series(words).value_counts(sort=False).to_numpy()
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    return np.array([
        np.log1p(n), kinds[1] / letters, kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7],
        min(1.0, data.count(b"!") / n), min(1.0, data.count(b"|") / n), min(20.0, lengths.mean()), len(counts) / n, again,
        len(set(lines)) / len(lines), sum(not (48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or 97 <= w[-1] <= 122 or w[-1] >= 128 or w[-1] in b".,;:?") for w in words) / n,
        sum(map(bytes.isupper, words)) / n, counts.max() / n, min(100.0, n / (1 + len(_SENTENCE.findall(data)))), (lengths <= 2).mean(), (lengths >= 15).mean(),
    ])


@dataclass
class Ranker:
    """score = logistic(weights (x - middle) / scale + offset), so that scores from ACCEPT on are accepted."""

    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    offset: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) + self.offset, -500, 500)))


def train(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = SEED, penalty: float = 1e-3) -> Ranker:
    """Weights that put the better of each pair first, by Newton's method on the logistic loss of differences.

    The threshold is the quantile of the raw training scores that leaves fewest of them on the
    wrong side, in the middle of the gap there. Without two classes all scores are the same: 0.5,
    or if all rows are bad 0.1.
    """
    size = x.shape[1]
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        p = 0.1 if len(worse) else 0.5
        return Ranker(np.zeros(size), np.ones(size), np.zeros(size), float(np.log(p / (1 - p))))
    middle, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    draw = np.random.default_rng(seed)
    z = np.clip((x - middle) / scale, -8, 8)
    difference = z[draw.choice(better, pairs)] - z[draw.choice(worse, pairs)]
    weights = np.zeros(size)
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(difference @ weights, -500, 500)))
        slope = difference.T @ p / pairs - penalty * weights
        bend = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + penalty * np.eye(size)
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ weights
    order = np.argsort(raw, kind="stable")
    ranked, is_good = raw[order], good[order]
    wrong = np.r_[0, np.cumsum(is_good)] + np.r_[np.cumsum(~is_good[::-1])[::-1], 0]  # k lowest are rejected
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    cut = ranked[0] - 1 if k == 0 else ranked[-1] + 1 if k == len(ranked) else (ranked[k - 1] + ranked[k]) / 2
    return Ranker(middle, scale, weights, float(np.log(ACCEPT / (1 - ACCEPT)) - cut))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learnt from: crc32 of doc_id as text, modulo 5, is 0 (null: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """A ranker from a bounded sample of the labelled rows outside the held-out fold.

    The sample is the first rows by a hash of doc_id, so it is the same in every run; its ids and
    the features of its documents, one for each id however often it is repeated, are bounded by the
    parameter.
    """
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    @F.pandas_udf(ArrayType(DoubleType()))
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    known = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(taken), "doc_id").select("doc_id", "quality", measured("text").alias("x"))
    rows = known.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect()
    if not rows:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0, bool))
    rows.sort(key=lambda r: (r["quality"], r["x"]))
    return train(np.array([r["x"] for r in rows]), np.array([r["quality"] == 1 for r in rows]))


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """docs with a column score."""

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))))

    return docs.withColumn("score", score(text_of()))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Labels (doc_id, quality 0 or 1; other values and nulls are passed over) are learnt outside the
    held-out fold only. A null text counts as empty; empty texts score like a text whose figures
    are all zero. Rows that repeat score alike; an empty table gives no rows; without labels of
    both kinds all scores are equal. Other columns are never inputs of a score.
    """
    out = scored(docs, fit(docs, labels, sample))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier accepts, with the columns of docs.

    A null text counts as empty and is scored as one; rows that repeat are judged alike; an empty
    table gives no rows. Without labels of both kinds all go or all stay.
    """
    ranker = fit(docs, labels, sample)
    marked = scored(docs.select("text", whole_row(docs).alias("doc")), ranker)
    return marked.where(F.col("score") >= ACCEPT).select("doc.*")
