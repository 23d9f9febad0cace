import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterfold.llm import exact, licenses, mixing, packing, pii, quality, secrets, simhash, substrings
from rasterfold.llm.registry import TOKENIZER

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows(frame):
    return [r.asDict() for r in frame.collect()]


# Exact dedup.
def brute_exact(docs):
    groups = defaultdict(list)
    for r in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    out = Counter()
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        for r in members:
            out[(r["doc_id"], best["doc_id"], len(members), r["doc_id"] == best["doc_id"], hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("bits", [128, 2])
def test_exact_groups(odd_docs, bits):
    """With two bits, most groups hold texts that only share their hash."""
    content_hash = exact.first_half if bits == 128 else lambda sha: F.unhex(F.translate(F.substring(sha, 1, 1), "0123456789abcdef", "0000111122223333"))
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(exact.exact_groups(odd_docs, content_hash)))
    assert got == brute_exact(rows(odd_docs))


def test_one_row_stays(odd_docs, no_docs):
    kept = rows(exact.without_copies(odd_docs))
    assert exact.without_copies(odd_docs).columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept) == [3, 4, 5, 6, 7, 8, 9]
    assert rows(exact.exact_groups(no_docs)) == rows(exact.without_copies(no_docs)) == []


# SimHash.
def brute_simhash(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    prints, parent = sorted(set(prints)), {}
    for p in prints:
        parent[p] = p

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 4:
                parent[root(p)] = root(q)
    return {p: root(p) for p in prints}


def test_simhash(odd_docs, no_docs):
    docs = [r for r in rows(odd_docs) if len(r["text"] or "") < 1000]
    got = {(r["doc_id"], r["fingerprint"]) for r in rows(simhash.near_duplicates(odd_docs))}
    assert {(r["doc_id"], f"{brute_simhash(r['text']):016x}") for r in docs} <= got
    assert rows(simhash.near_duplicates(no_docs)) == rows(simhash.one_of_each(no_docs)) == []
    kept = [r["doc_id"] for r in rows(simhash.one_of_each(odd_docs))]
    assert sorted(kept) == sorted({r["component_id"] for r in rows(simhash.near_duplicates(odd_docs))})


@pytest.mark.parametrize("piece", [8, 4096])
def test_links(spark, piece):
    """Clusters, bridges between them and noise; with pieces of 8 all large signatures are split."""
    draw, prints = np.random.default_rng(3), [0]
    for _ in range(20):
        center = int(draw.integers(0, 2**63))
        for _ in range(25):
            prints.append(center := center ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(1, 6), replace=False)))
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in set(prints)], "fp long")
    found = simhash.components(simhash.links(frame, piece))
    label = {int(np.int64(r["node"]).view(np.uint64)): r["component"] for r in rows(found)}
    want = brute_components(prints)
    groups = defaultdict(set)
    for p, r in want.items():
        groups[r].add(p)
    got = defaultdict(set)
    for p in want:
        got[label.get(p, ("alone", p))].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


# Personal data.
def test_pii(make_docs, no_docs):
    text = "😀 mail bob.x@mail.example.com, a@b.c_d@e.f ip 10.0.0.255 or 1.2.3.256; card 4111 1111 1111 1111 not 4111 1111 1111 1112; tel +1 (212) 555-0101 iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789 and 123-45-6789"
    r = rows(pii.pii_report(make_docs([(1, text), (2, None), (3, "x" * 200_000 + "@"), (4, "1." * 50_000)])))
    one = next(x for x in r if x["doc_id"] == 1)
    assert (one["n_email"], one["n_ip"], one["n_card"], one["n_phone"]) == (3, 1, 1, 1)
    kinds = [s.split(":") for s in one["spans"].split(",")]
    assert [text[int(a) : int(b)] for k, a, b in kinds if k in ("iban", "ssn", "phone")] == ["+1 (212) 555-0101", "DE89 3704 0044 0532 0130 00", "123-45-6789"]
    assert all(x["spans"] == "" and x["base_sha256"] == hashlib.sha256(b"").hexdigest() for x in r if x["doc_id"] in (2, 3))
    clean = rows(pii.redact(make_docs([(1, "to a@b.cd now"), (2, None)])))
    assert [x["text"] for x in sorted(clean, key=lambda x: x["doc_id"])] == ["to [email] now", ""]
    assert rows(pii.pii_report(no_docs)) == []


# Licenses.
def test_licenses(make_docs, no_docs):
    docs = make_docs([(1, "Some GNU  General-Public license, then the MIT\nlicense. gnu general public licenses"), (2, None), (3, "Permission is hearby granted, free of charge, to any persons obtaining a copy"), (4, "released under the M1T license"), (5, "cc bye"), (6, "z " * 100_000 + "cc by")])
    r = {x["doc_id"]: x for x in rows(licenses.find_licenses(docs))}
    assert (r[1]["n_words"], r[1]["n_base"], r[1]["first_word"], r[1]["last_word"], r[1]["base_labels"], r[1]["score"]) == (13, 2, 1, 7, "gpl,mit", 1.0)
    assert (r[2]["n_words"], r[2]["first_word"], r[2]["labels"], r[2]["score"]) == (0, None, "", 0.0)
    assert r[3]["labels"] == "mit" and r[3]["n_base"] == 0 and r[3]["notices"][0]["edits"] == 3 and 0.5 <= r[3]["score"] < 1
    assert r[4]["labels"] == "mit" and r[5]["n_base"] == 0 and r[6]["first_word"] == 100_000
    assert rows(licenses.find_licenses(no_docs)) == []


# Quality.
def test_quality(spark, no_docs):
    draw = np.random.default_rng(1)
    words = ["the", "river", "stone", "runs", "under", "old", "bridge", "while", "people", "walk"]
    good = [" ".join(draw.choice(words, 60)).capitalize() + "." for _ in range(150)]
    bad = ["!! ".join(w.upper() for w in draw.choice(words, 60)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    r = rows(quality.classify(docs.withColumn("score", F.lit("x")), labels))
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in r)
    out = [x for x in r if x["held_out"]]
    assert len(r) == 300 and sum(x["predicted"] == int(x["doc_id"] < 150) for x in out) == len(out) > 30
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in r)
    assert {x["score"] for x in rows(quality.classify(docs, labels.limit(0)))} == {0.5}
    assert rows(quality.classify(no_docs, labels)) == []
    assert quality.accepted(docs, labels).count() == 150


# Mixing.
def test_mixing(odd_docs, no_docs, make_docs):
    docs = make_docs([(i, "w " * (i % 50), f"s{i % 4}") for i in range(400)] + [(1000, None, None), (1001, "a b c", None)])
    r = rows(mixing.mix(docs))
    again = rows(mixing.mix(docs.repartition(7)))
    assert sorted(map(str, r)) == sorted(map(str, again)) and len(r) == 402
    for s in {x["source"] for x in r}:
        own = [x for x in r if x["source"] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 3 and all(x["taken"] <= 2 * x["size"] for x in own)
        assert own[0]["source_size"] == sum(x["size"] for x in own)
    assert abs(sum({x["source"]: x["target"] for x in r}.values()) - 1.5 * sum(x["size"] for x in r)) < 1e-6
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(mixing.n_words())).first()[0] == sum(x["taken"] for x in r)
    assert len(rows(mixing.mix(odd_docs))) == 11 and rows(mixing.mix(no_docs)) == rows(mixing.mixed(no_docs)) == []


# Packing.
def test_packing(odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    odd = ["don't Stop 'STUFF's", "ΑΣ ΣΑΣ, İI ﬁne a≮ b", "x <|endoftext|>y", "<|startoftext|", "áb é, É!É ...", "汉字 ok,then 12,3", "nbsp\x1c x\x85y\tz\r", "İ.", "", "   ", "ñ. Ñ!!"]
    for got, text in zip(packing.token_ids(odd, TOKENIZER), odd, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    r = rows(packing.pack(odd_docs, TOKENIZER, with_ids=True))
    by_sequence = defaultdict(list)
    for x in r:
        by_sequence[x["sequence_id"]].append((x["offset"], x["length"]))
        assert zlib.crc32(np.array(x["ids"], "<u4").tobytes()) == x["ids_crc32"] and len(x["ids"]) == x["length"]
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    whole = sorted((x["piece"], x["ids"]) for x in r if x["doc_id"] == 4)
    text = next(x["text"] for x in rows(odd_docs) if x["doc_id"] == 4)
    assert sum((ids for _, ids in whole), []) == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert len(by_sequence) <= -(-sum(x["length"] for x in r) // 2048) + 1
    assert rows(packing.pack(no_docs, TOKENIZER)) == []


def test_best_fit_closes_the_fullest():
    packer = packing.BestFit(10, 2)
    assert [packer.put(n) for n in (6, 7, 8, 3, 2, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 8), (3, 0)]


# Repeated passages.
def brute_repeats(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2048, 2])
def test_repeats(make_docs, no_docs, hot):
    draw = np.random.default_rng(5)
    noise = lambda n: "".join(draw.choice(list("abcdefgh é"), n))
    passage, copy = noise(260), noise(500)
    texts = [noise(300) + passage + noise(40), passage + noise(100), noise(9) + passage[:230], copy, copy, copy[:250] + "X" + copy[250:], "a" * 450, "ab" * 210, None, "", noise(199), passage[:199], passage[30:240] + "q" + passage[:201]]
    docs = make_docs([(i if i != 1 else None, t) for i, t in enumerate(texts)])
    got = [(x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows(substrings.repeated_passages(docs, hot))]
    assert Counter(got) == Counter(brute_repeats([(t or "").encode() for t in texts]))
    assert rows(substrings.repeated_passages(no_docs)) == [] and substrings.without_repeats(docs).columns == docs.columns


def test_suffix_array():
    from rasterfold.llm.grouping import suffix_array

    draw = np.random.default_rng(2)
    for _ in range(300):
        x = draw.integers(1, draw.integers(2, 9), draw.integers(0, 60)).tolist()
        assert suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffix_arrays_of_many_strings():
    from rasterfold.llm.grouping import suffix_array, suffix_arrays

    draw = np.random.default_rng(3)
    for trial in range(60):
        x = draw.integers(1, draw.integers(2, 6), (draw.integers(1, 9), draw.integers(1, 50)))
        if trial % 3 == 0:
            x = np.tile(x[:, : 1 + x.shape[1] // 4], (1, 5))
        rows = np.concatenate([x, np.zeros((len(x), 1), np.int64)], axis=1)
        for row, got in zip(x, suffix_arrays(rows), strict=True):
            assert got.tolist() == [len(row), *suffix_array(row).tolist()]


def test_repeated_windows_of_many_groups():
    draw, left, right, group = np.random.default_rng(4), [], [], []
    for g in range(60):
        a, b = draw.integers(97, 99, 35).astype(np.uint8).tobytes(), draw.integers(97, 99, 35).astype(np.uint8).tobytes()
        for _ in range(draw.integers(1, 6) if g else 40):
            x, y = draw.integers(0, 36, 2)
            left.append((b"z" * int(draw.integers(0, 3)) + a[x:])[-35:])
            right.append(b[: 35 - y] + bytes([65 + draw.integers(0, 3)]) * int(draw.integers(0, y + 1)))
            group.append(g)
    times = draw.integers(1, 3, len(group))
    count = Counter()
    windows = [[(g, len(a) - i, a[i:], b[: 35 - len(a) + i]) for i in range(len(a) + len(b) - 34)] for a, b, g in zip(left, right, group, strict=True)]
    for w, n in zip(windows, times.tolist(), strict=True):
        count.update({x: n for x in w})
    for w, first, last in zip(windows, *substrings.repeated_windows(left, right, np.array(group), times), strict=True):
        again = [i for i, x in enumerate(w) if count[x] > 1]
        assert (first, last) == ((again[0], again[-1]) if again else (-1, -1))


def test_long_text_in_parts(make_docs, monkeypatch):
    monkeypatch.setattr(substrings, "_PART", 400)
    monkeypatch.setattr(substrings, "_table", [])
    draw = np.random.default_rng(8)
    texts = ["".join(draw.choice(list("abc"), 3000)).encode() for _ in range(2)]
    whole = {(n, p) for which, places, _ in substrings._anchors(texts) for n, p in zip(which.tolist(), places.tolist(), strict=True)}
    monkeypatch.undo()
    again = [(n, p) for which, places, _ in substrings._anchors(texts) for n, p in zip(which.tolist(), places.tolist(), strict=True)]
    assert len(again) == len(set(again)) and whole == set(again)


# Secrets.
def test_secrets(spark, make_docs, no_docs):
    held = secrets.labelled_findings(600, seed=99)
    model = secrets.train_forest(spark)
    docs = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(held)], "doc_id long, text string, source string")
    found = {}
    for x in rows(secrets.scan_secrets(docs, model)):
        found.setdefault(x["doc_id"], x["is_secret"])
    right = [found[i] == s for i, (_, _, s) in enumerate(held) if i in found]
    assert sum(right) / len(right) > 0.95 and len(found) > 450
    text = '😀 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ###'
    got = rows(secrets.scan_secrets(make_docs([(1, text), (2, None), (3, "x" * 300_000), (4, "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]), model))
    assert [(x["doc_id"], text[x["start"] : x["end"]]) for x in got if x["is_secret"]] == [(1, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    assert rows(secrets.scan_secrets(no_docs, model)) == []
