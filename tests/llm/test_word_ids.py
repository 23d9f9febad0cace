"""Ids by parts of words: those of whole texts, at any size of window and memory, with each part learnt once."""

import random
from array import array

import pytest

from rasterfold.llm import packing
from rasterfold.llm.registry import TOKENIZER


@pytest.fixture
def small(monkeypatch):
    """A worker that remembers few parts and cuts texts into short windows."""
    monkeypatch.setattr(packing, "REMEMBERED", 1000)
    monkeypatch.setattr(packing, "_words", {})
    return monkeypatch


def check(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    for text, ids in zip(texts, packing.token_ids(texts, TOKENIZER), strict=True):
        assert ids == array("I", [*whole.encode(text, add_special_tokens=False).ids, packing.END_ID]).tobytes(), ascii(text)


def test_special_tokens_in_capitals_are_words():
    check(["<|ENDOFTEXT|> x", "a <|EndOfText|>", "<|endoftext|>", "x<|startoftext|>Y <|STARTOFTEXT|>"])


@pytest.mark.parametrize("letters", ["strevmldSTREVMLD'''' .,\"(1é", "aJKIÉ×÷̸̌̇́<=>^ \r\n\t\x0b\x0c\x1c\x85\xa0'2²½", "".join(map(chr, range(0x180))) + " " * 30])
def test_windows_and_memory_change_no_ids(small, letters):
    draw = random.Random(letters)
    small.setattr(packing, "WINDOW", 50)
    check(["".join(draw.choice(letters) for _ in range(draw.randint(0, 300))) for _ in range(300)])
    check(["x" * 120, "", "x" * 49 + " y", "", " " * 51, "É" * 60 + "."])


def test_parts_in_use_are_learnt_once(small):
    learnt, learn = [], packing.WordIds._learn
    small.setattr(packing.WordIds, "_learn", lambda self, parts: learnt.extend(parts) or learn(self, parts))
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(12))
    common, rare = sorted({word() for _ in range(500)}), [word() for _ in range(8000)]
    for at in range(0, len(rare), 400):
        packing.token_ids(["".join(f" {w}" for w in [*common, *rare[at : at + 400]])], TOKENIZER)
    assert len(learnt) <= len(common) + len(rare)


def test_numbers_and_marks_are_few_parts(small):
    learnt, learn = [], packing.WordIds._learn
    small.setattr(packing.WordIds, "_learn", lambda self, parts: learnt.extend(parts) or learn(self, parts))
    check([" ".join(f"f({i}).x={i * 7}" for i in range(1000))])
    assert len(learnt) < 50


def test_long_parts_are_not_kept(small):
    check(["\u6f22" * n for n in (3, 5000, 5000)] + ["y" * 70])
    assert set(packing._words[TOKENIZER].known) == {"\u6f22" * 3}
