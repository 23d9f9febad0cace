"""The prefix trie against a plain one, over odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rasterfold.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node string, owner long, at long"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((hashlib.sha256((role or "").encode()).hexdigest() + (text or "")).encode()).hexdigest(), text or ""))
    turns = {c: [(r[2], r[4]) for r in sorted(x, key=lambda r: r[:4])] for c, x in own.items()}
    built = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 6, int(c - __import__("math").fmod(c, 100))
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in m if len(built[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def answered(spark, rows):
    return sorted(map(tuple, prefix_trie(spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)).collect()), key=repr)


def test_odd_rows(spark):
    long = "very long " * 50_000
    rows = [(100, 0, "user", "a"), (100, 1, None, None), (100, 2, "user", "b"), (101, None, "user", "first"), (101, 0, "user", "second"), (101, 0, "user", "second"), (102, 0, "user", long), (102, 1, "user", "😀 x"), (None, 0, "user", "nobody's"), (-7, 0, "user", "a"), (-107, 3, "user", "a"), (205, 0, "", ""), (311, 0, "user", "only own turn, which goes"), (100, 2, "user", "c")]
    assert answered(spark, rows) == plain(rows)


def test_copies_and_nested_chains(spark):
    draw = random.Random(3)
    rows = []
    for c in range(0, 420, 3):
        for t in range(draw.randint(1, 9)):
            rows.append((c, t, draw.choice(("user", "assistant")), draw.choice("ab")))
    for c in range(1000, 1040):  # each goes one turn further than the one before
        rows += [(c * 100, t, "user", "same") for t in range(c - 998)]
    rows += [(c * 100, t, "user", f"copy {t}") for c in range(2000, 2300) for t in range(3)]
    assert answered(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(5, 0, "user", "a")]])
def test_none_and_one(spark, rows):
    assert answered(spark, rows) == plain(rows)
