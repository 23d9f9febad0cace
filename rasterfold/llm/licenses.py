"""License notices: exact phrases, and short notices with errors found from exact seeds."""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from rasterfold.llm.common import text_of

#: The phrases that count as they stand, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Short notices in words, with the edits (of characters) that each may have.
NOTICES = (
    ("cc by", "cc-by", 0),
    ("gnu general public license", "gpl", 2),
    ("apache license", "apache", 1),
    ("mit license", "mit", 1),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu library general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("gnu free documentation license", "gfdl", 2),
    ("this program is free software you can redistribute it and or modify it", "gpl", 6),
    ("licensed under the apache license version 2", "apache", 4),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("released under the mit license", "mit", 3),
    ("licensed under cc by nc 4", "cc-by-nc", 2),
    ("licensed under cc by sa 4", "cc-by-sa", 2),
    ("licensed under cc by nd 4", "cc-by-nd", 2),
    ("licensed under cc by 4", "cc-by", 2),
    ("creative commons attribution", "cc-by", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("creative commons attribution noderivatives", "cc-by-nd", 3),
    ("creative commons zero", "cc0", 2),
    ("cc0 1 0 universal", "cc0", 1),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 8),
    ("bsd 2 clause license", "bsd", 1),
    ("bsd 3 clause license", "bsd", 1),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("european union public licence", "eupl", 2),
    ("common development and distribution license", "cddl", 4),
    ("boost software license", "bsl", 2),
    ("academic free license", "afl", 2),
    ("sil open font license", "ofl", 2),
    ("open database license", "odbl", 2),
    ("this software is provided as is without any express or implied warranty", "zlib", 6),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
    ("released into the public domain", "public-domain", 3),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 7),
    ("all rights reserved", "all-rights-reserved", 1),
)
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_IS_WORD = np.array([chr(b) != " " for b in _TO_WORDS])
_GOES_ON = np.array([b & 0xC0 == 0x80 for b in range(256)])


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of about equal length: one of them at least stands unchanged in any match."""
    at = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:], strict=False)]


@cache
def _tools():
    """The seed automaton and the patterns, made once in each Python worker."""
    places: dict[str, list[tuple[int, int]]] = {}
    for n, (notice, _, edits) in enumerate(NOTICES):
        for at, seed in seeds(notice, edits):
            places.setdefault(seed, []).append((n, at))
    automaton = ahocorasick.Automaton()
    for seed, where in places.items():
        automaton.add_word(seed, (len(seed), where))
    automaton.make_automaton()
    patterns = [regex.compile(rf"(?e)(?<![^ ])(?:{notice}){{e<={edits}}}(?![^ ])") for notice, _, edits in NOTICES]
    phrases = [re.compile(rf"(?<![^ ]){re.escape(p)}(?![^ ])") for p, _ in PHRASES]
    return automaton, patterns, phrases


def _fuzzy(text: str) -> list[tuple[int, int, int]]:
    """(notice, begin, end, edits) of verified matches in a text of single-spaced words, places in characters."""
    automaton, patterns, _ = _tools()
    windows: dict[int, list[list[int]]] = {}
    for last, (size, where) in automaton.iter(text):
        for n, at in where:
            notice, _, edits = NOTICES[n]
            begin = last - size + 1 - at - edits
            end = begin + len(notice) + 2 * edits
            known = windows.setdefault(n, [])
            if known and begin - 1 <= known[-1][1]:
                known[-1][1] = max(known[-1][1], end + 1)
                known[-1][0] = min(known[-1][0], begin - 1)
            else:
                known.append([begin - 1, end + 1])
    found = []
    for n, spans in windows.items():
        for begin, end in spans:
            stop = text.find(" ", min(len(text), end))  # a window that ends within a word would find its beginning
            for m in patterns[n].finditer(text, max(0, begin), len(text) if stop < 0 else stop, overlapped=False):
                found.append((n, m.start(), m.end(), sum(m.fuzzy_counts)))
    return found


def scan(text: str) -> tuple[int, list[tuple[str, int, int, int]], list[tuple[str, int, int, int, int, int]]]:
    """Number of words, exact phrases (label, word, start, end), notices (label, first word, words, edits, start, end).

    Words are numbered from 0; start and end are places in the text in code points, end exclusive.
    """
    whole = text.encode("utf-8", "surrogatepass")
    data = whole.translate(_TO_WORDS)
    if not data.strip(b" "):
        return 0, [], []
    mask = _IS_WORD[np.frombuffer(data, np.uint8)]
    n_words = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
    words = " ".join(data.decode("utf-8", "surrogatepass").split(" ")) if b"  " not in data and data[:1] != b" " else b" ".join(data.split()).decode("utf-8", "surrogatepass")
    exact = [(label, *m.span()) for (_, label), p in zip(PHRASES, _tools()[2], strict=True) for m in p.finditer(words)]
    notices = [(NOTICES[n][1], a, b, edits) for n, a, b, edits in _fuzzy(words)]
    if not exact and not notices:
        return n_words, [], []
    joined = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), "<u4") == 32
    before = np.concatenate([[0], np.cumsum(joined)])  # spaces before each place
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    point = np.concatenate([[0], np.cumsum(~_GOES_ON[np.frombuffer(whole, np.uint8)])])  # code points before each byte
    starts, ends = point[np.flatnonzero(edge == 1)], point[np.flatnonzero(edge == -1)]

    def place(a: int, b: int) -> tuple[int, int, int, int]:
        first, last = int(before[a]), min(int(before[b]), n_words - 1)
        return first, last - first + 1, int(starts[first]), int(ends[last])

    found, phrases = [], []
    for label, a, b in exact:
        first, _, start, end = place(a, b)
        phrases.append((label, first, start, end))
    for label, a, b, edits in notices:
        first, size, start, end = place(a, b)
        found.append((label, first, size, edits, start, end))
    return n_words, phrases, found


_RESULT = StructType([
    StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()), StructField("last_word", LongType()),
    StructField("base_labels", StringType()), StructField("labels", StringType()),
    StructField("notices", ArrayType(StructType([StructField("label", StringType()), *(StructField(x, LongType()) for x in ("word", "n_words", "edits", "start", "end"))]))),
])


@F.pandas_udf(_RESULT)
def _scanned(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        n_words, exact, notices = scan(text)
        places = [x[1] for x in exact]
        base = {x[0] for x in exact}
        rows.append((n_words, len(exact), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in notices})), [dict(zip(("label", "word", "n_words", "edits", "start", "end"), x, strict=True)) for x in sorted(notices, key=lambda x: (x[4], x[5], x[0]))]))
    out = pd.DataFrame(rows, columns=_RESULT.names)
    return out.astype({"first_word": "Int64", "last_word": "Int64"})


def find_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lowered, counted from 0.
    Base columns tell where the fixed phrases stand word for word. Notices are searched in the
    whole text with edits: a notice that may have k is cut into k + 1 seeds, and where a seed
    stands the regex library looks for the whole with at most k edits between word ends. Each is
    reported with its label, first word, number of words, edits, and its span in the text (start,
    end in code points, end exclusive), ordered by start. labels joins both. score is 1 where a phrase or an unchanged notice stands, less by 0.05 for each edit
    of the best notice otherwise, 0 without any. A null text counts as empty: no words, no labels.
    Rows that repeat are answered alike; an empty table gives no rows; other columns are ignored.
    One pass, no shuffle.
    """
    found = docs.select("doc_id", _scanned(text_of()).alias("r")).select("doc_id", "r.*")
    edits = F.array_min(F.transform("notices", lambda x: x["edits"]))
    score = F.when(F.col("n_base") > 0, 1.0).when(F.size("notices") > 0, F.greatest(F.lit(0.5), 1.0 - 0.05 * edits)).otherwise(0.0)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", score.cast("double").alias("score"), "notices")
