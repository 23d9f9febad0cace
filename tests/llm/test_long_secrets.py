"""Secrets of any length are found whole."""

import random
import string

import pytest

from rasterfold.llm import secrets


@pytest.mark.parametrize("n", [200, 201, 5000])
def test_long_values(n):
    value = "".join(random.Random(n).choices(string.ascii_letters + string.digits + "+/", k=n - 1)) + "7"
    for kind, text in (("long_string", f"see {value} there"), ("assignment", f'secret = "{value}" there')):
        found = [(k, text[a:b]) for k, a, b, _ in secrets.candidates(text, "src")]
        assert found == [(kind, value)]
    late = "A" * (n - 1) + "7"
    assert [(k, b - a) for k, a, b, _ in secrets.candidates(f"see {late}", "src")] == [("long_string", n)]


def test_long_runs_take_linear_time():
    assert list(secrets.candidates("-" * 300_000 + " " + "ab+/" * 75_000, "src")) == []
    wide = "".join(map(chr, range(0x4E00, 0x9000))) * 20
    assert [b - a for _, a, b, _ in secrets.candidates("token: " + wide, "src")] == [len(wide)]


def test_web_tokens_take_linear_time():
    import time

    began = time.time()
    assert not [c for c in secrets.candidates("-eyJ" * 500_000, "src") if c[0] == "web_token"]
    assert time.time() - began < 20
    token = "eyJ" + "a" * 20 + "." + "b" * 30 + "." + "c" * 20
    assert [(k, b - a) for k, a, b, _ in secrets.candidates(f"x {token} y", "src")] == [("web_token", len(token))]


def test_coverage_by_words():
    words, sizes = secrets.words_of(None)
    assert all(n in sizes[w[:4]] for w in words for n in [len(w)])
    assert secrets.covered("xxaccountyydatabasezz", None) == len("accountdatabase") and secrets.covered("", None) == 0
