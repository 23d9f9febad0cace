"""Passages shared by many documents: no suffix array takes all their edges."""

from collections import Counter

import numpy as np
import pytest
from test_text_operators import brute_repeats, rows

from rasterfold.llm import substrings


@pytest.fixture(scope="module")
def texts():
    draw = np.random.default_rng(6)
    noise = lambda n: "".join(draw.choice(list("abcdefgh é"), n))
    passage = noise(420)
    texts = [noise(int(draw.integers(0, 90))) + passage + noise(int(draw.integers(0, 90))) for _ in range(60)]
    return [*texts, *(t[-300:] for t in texts[:9]), *(t[:280] for t in texts[:9]), texts[0], passage, passage[1:], passage[:215] + "q", "a" * 450]


@pytest.mark.parametrize("large", [0, 4, 30])
def test_edges_of_a_common_passage(make_docs, texts, large):
    docs = make_docs(list(enumerate(texts)))
    got = [(x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows(substrings.repeated_passages(docs, 2, large))]
    assert Counter(got) == Counter(brute_repeats([t.encode() for t in texts]))


def test_no_group_is_large(spark):
    """The edge of a banner: 500 documents go on in different ways, all after the same 17 bytes."""
    draw = np.random.default_rng(7)
    counted = spark.createDataFrame([(1, i, bytearray(b"b" * 35), bytearray(draw.bytes(35)), 1) for i in range(500)], "h long, k long, left binary, right binary, n long")
    grouped, windows = substrings._halves(counted, 100)
    assert max(r["count"] for r in grouped.groupBy("g").count().collect()) <= 100
    assert windows.count() == 500 * 18
    sides = [(bytes(r["left"]), bytes(r["right"])) for r in counted.orderBy("k").collect()]
    first, last = substrings.repeated_windows([a for a, _ in sides], [b for _, b in sides], np.zeros(500, np.int64), np.ones(500, np.int64))
    got = {r["k"]: (r["first"], r["last"]) for r in substrings._again(windows).collect()}
    assert got == {i: x for i, x in enumerate(zip(first.tolist(), last.tolist(), strict=True)) if x[0] >= 0}
