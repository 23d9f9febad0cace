import numpy as np
from pyspark.sql import functions as F

from rasterfold.llm import ann

KIND = "vec_id long, embedding array<float>, label int, rank int"


def brute(rows, k):
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for q, v in vectors.items():
        if q % 20 == 0:
            scored = sorted(((-float((v * w).sum()), i) for i, w in vectors.items() if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def make(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0) for i, v in rows], KIND)


def found(frame, **options):
    out = {}
    for r in sorted(ann.nearest(frame, F.col("vec_id") % 20 == 0, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_blocks(spark):
    draw = np.random.default_rng(4)
    x = np.float32(draw.normal(size=(1500, 24)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, 20)
    for block in (4096, 32):
        got = found(make(spark, rows), block=block)
        hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values()) and hit >= 0.9 * 20 * len(want)


def test_copies_ties_and_odd_vectors(spark):
    same = [1.0, 2.0, 0.0, 0.5]
    rows = [(i, same) for i in range(0, 70)] + [(i, same) for i in range(0, 5)] + [(100, [0.0] * 4), (120, None), (140, [1.0, None, 0.0, 0.0]), (160, [float("nan")] * 4), (180, [float("inf"), 0, 0, 0]), (200, [-1.0, 0.0, 0.0, 1.0]), (220, [])]
    got = found(make(spark, rows))
    assert sorted(got) == [0, 20, 40, 60, 200]
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[20]] == list(range(0, 20)) and [i for i, _ in got[200]] == list(range(0, 20))
    assert all(s == 5.25 for _, s in got[40])


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])]
    assert found(make(spark, rows)) == {0: [(1, 0.0), (2, -1.0)]}
    assert found(make(spark, [])) == {} and found(make(spark, [(20, [1.0])])) == {}


def test_ties_of_different_vectors(spark):
    draw = np.random.default_rng(6)
    x = draw.integers(0, 2, (700, 8)) * 0.001
    x[:, 0] = draw.integers(100, 103, 700)
    x[:20, 1:] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(np.float32(x))]
    score = [(i, -float(x[0, 0] * v[0])) for i, v in rows]
    got, want = found(make(spark, rows), block=64), brute(rows, 20)
    assert want[0] != sorted(score)[:20] and got.keys() == want.keys()
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)


def test_other_lengths_take_no_part(spark):
    draw = np.random.default_rng(7)
    rows = [(0, [1.0] * 7), (20, [1.0, 2.0])] + [(i, draw.normal(size=5).tolist()) for i in range(30, 90)]
    got = found(make(spark, rows))
    assert sorted(got) == [40, 60, 80] and all(len(v) == 20 and not {i for i, _ in v} & {0, 20} for v in got.values())


def test_recall_by_size(spark):
    for n, options in ((2000, {}), (10_000, {}), (10_000, {"polytopes": 2, "tables": 10, "count": 60})):
        draw = np.random.default_rng(n)
        middle = draw.normal(size=(n // 50, 32))
        x = np.float32(np.repeat(middle, 50, axis=0) + 0.4 * draw.normal(size=(n, 32)))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        got = found(make(spark, [(i, v.tolist()) for i, v in enumerate(x)]), **options)
        asking = np.arange(0, n, 20)
        near = np.float64(x[asking]) @ np.float64(x).T
        near[np.arange(len(asking)), asking] = -9
        best = np.argsort(-near, axis=1)[:, :20]
        hit = sum(len({i for i, _ in got[q]} & set(b)) for q, b in zip(asking.tolist(), best.tolist(), strict=True))
        assert len(got) == len(asking) and hit >= 0.9 * 20 * len(asking), (n, options, hit / 20 / len(asking))
