"""Seeds and windows find what a search of whole texts finds."""

import random

import regex

from rasterfold.llm import licenses


def noisy(draw, notice, edits):
    out = list(notice)
    for _ in range(draw.randint(0, edits + 1)):
        i, kind = draw.randrange(len(out)), draw.random()
        if kind < 0.35:
            out[i] = draw.choice("abcdefgh ")
        elif kind < 0.7 and len(out) > 1:
            del out[i]
        else:
            out.insert(i, draw.choice("xyz "))
    return "".join(out)


def test_against_whole_texts():
    draw, known = random.Random(5), [(label, regex.compile(rf"(?<![^ ])(?:{n}){{e<={e}}}(?![^ ])")) for n, label, e in licenses.NOTICES]
    words = lambda of, most: " ".join(draw.choice(of) for _ in range(draw.randint(0, most)))
    seen = set()
    for _ in range(300):
        parts = [words(("lorem", "ipsum", "license", "public", "the", "of", "mit", "gnu", "apache"), 12)]
        for _ in range(draw.randint(0, 3)):
            notice, _, edits = draw.choice(licenses.NOTICES)
            parts += [noisy(draw, notice, edits), words(("lorem", "license", "general", "by", "cc"), 6)]
        text = " ".join(" ".join(parts).split())
        n_words, exact, found = licenses.scan(text)
        assert n_words == len(text.split()) and {x[0] for x in found} == {label for label, p in known if p.search(text)}
        for _, word, size, _, start, end in found:
            assert " ".join(text.split()[word : word + size]) == text[start:end]
        want = sorted((label, len(text[: m.start()].split())) for phrase, label in licenses.PHRASES for m in regex.finditer(rf"(?<![^ ]){phrase}(?![^ ])", text))
        assert sorted(x[:2] for x in exact) == want
        seen |= {x[0] for x in found}
    assert len(seen) > 20


def test_spans_are_of_the_text_as_it_came():
    text = "Été: MIT  License… 漢字 GNU general-public\nlicence!"
    assert [(x[0], text[x[4] : x[5]]) for x in licenses.scan(text)[2]] == [("mit", "MIT  License…"), ("gpl", "GNU general-public\nlicence")]


def test_repeated_rows_and_many_phrases(make_docs):
    docs = make_docs([(1, "MIT License"), (1, "MIT License"), (2, "mit license " * 20_000), (3, None), (None, "cc by")])
    found = {(r["doc_id"], r["n_base"], r["first_word"], r["last_word"], r["labels"], len(r["notices"])) for r in licenses.find_licenses(docs).collect()}
    assert found == {(1, 1, 0, 0, "mit", 1), (2, 20_000, 0, 39_998, "mit", 20_000), (3, 0, None, None, "", 0), (None, 1, 0, 0, "cc-by", 1)}
