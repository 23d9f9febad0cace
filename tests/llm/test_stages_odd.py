"""The pipeline's stages over nulls, empty and very long texts, repeated rows, clashing columns, and nothing at all."""

from collections import Counter

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows(spark, odd_docs, no_docs, name):
    got = STAGES[name](spark, odd_docs, SF)
    ids = Counter(r["doc_id"] for r in got.collect())
    if name == "quality":
        assert got.columns == odd_docs.columns and set(ids) <= {1, 2, 3, 4, 5, 6, 7, 8, 9, None} and ids[6] in (0, 2)
    elif name == "exact_dedup":
        assert got.columns == odd_docs.columns and ids == Counter((3, 4, 5, 6, 7, 8, 9))
    elif name == "near_dedup":
        assert got.columns == odd_docs.columns and ids == Counter((1, 4, 6, 8, 9))
    elif name == "mixing":
        assert got.columns == odd_docs.columns and not set(ids) & {1, 2, 3} and max(ids.values()) <= 4 and {8, 9} <= set(ids)
    else:
        assert set(ids) == {1, 2, 3, 4, 5, 6, 7, 8, 9, None} and ids[4] > 20 and ids[6] == 2
    assert STAGES[name](spark, no_docs, SF).collect() == []


def test_other_columns_stay_with_their_rows(spark, odd_docs):
    kept = {r["doc_id"]: r for r in STAGES["exact_dedup"](spark, odd_docs, SF).collect()}
    assert all((r["score"], r["h"], r["kept"], r["n_chars"]) == (1, "x", None, len(r["text"] or "")) for r in kept.values())
