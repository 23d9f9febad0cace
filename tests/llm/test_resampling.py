"""Importance resampling against a plain version, over odd rows and all chunk sizes."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from rasterfold.llm.resampling import chunks_of, resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, n, buckets, per_cent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in features(text, n)[1])
    t = Counter(bucket(f) for text in target for f in features(text, n)[1])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        words, found = features(text, n)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    most = len(able) * per_cent // 100
    return Counter([(*r, k + 1 if k < most else None) for k, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < least])


@pytest.mark.parametrize(("n", "size"), [(1, 1 << 15), (1, 40), (3, 64), (2, 1)])
def test_against_plain(spark, odd_docs, n, size):
    docs = odd_docs.union(odd_docs.limit(0))
    extra = [(20 + i, f"Shared words of a plain text number {i % 7} " * (i % 5 + 1)) for i in range(40)] + [(None, "!?! ... " * 30), (30, "___ " * 50)]
    schema = docs.schema
    docs = docs.union(spark.createDataFrame([(i, t, None, "s", 0, 0, 0, None, None) for i, t in extra], schema))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = ["shared words of a target", None, "", "plain text " * 30]
    got = resample(docs, spark.createDataFrame([(k, t, "clash") for k, t in enumerate(target)], "item_id long, text string, doc_id string"), n=n, buckets=50, per_cent=30, least_words=6, size=size)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == plain(rows, target, n, 50, 30, 6)


def test_empty_tables(spark, no_docs, odd_docs):
    target = spark.createDataFrame([], "text string")
    assert resample(no_docs, target).count() == 0
    assert resample(odd_docs, target).count() == odd_docs.count()


@pytest.mark.parametrize("size", [1, 7, 100])
def test_chunks_own_every_word_once(size):
    text = ("Some words, AND numbers 123 éa; " * 9).encode()
    chunks = list(chunks_of(text, 3, size))
    owned = [w for words, k in chunks for w in words.split()[:k]]
    assert owned == re.findall(rb"[^ ]+", b" ".join(b" ".join(words.split()[:k]) for words, k in chunks)) and len(owned) == 9 * 6
    grams = [tuple(words.split()[i : i + 3]) for words, k in chunks for i in range(k)]
    assert grams == [tuple(owned[i : i + 3]) for i in range(len(owned))]
