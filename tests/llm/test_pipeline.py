"""The pipeline's stages against plain versions of them, and all of it from end to end."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from test_text_operators import brute_components, brute_simhash

from rasterfold.llm import quality
from rasterfold.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    before, columns = docs.collect(), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(out := f"{tmp_path}/{k}")
        docs = spark.read.parquet(out)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns and after
        if name == "quality":
            ranker = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
            want = [r["doc_id"] for r in before if ranker.score(quality.features(r["text"] or "")[None, :])[0] >= quality.ACCEPT]
            assert sorted(r["doc_id"] for r in after) == sorted(want)
            bad = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 0").collect()}
            assert len(bad & set(want)) <= 0.1 * len(bad) and len(want) > 0.8 * (len(before) - len(bad))
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for r in before:
                groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
            assert Counter(r["doc_id"] for r in after) == Counter(min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"]))["doc_id"] for g in groups.values())
        elif name == "near_dedup":
            prints = {r["doc_id"]: brute_simhash(r["text"]) for r in before}
            root, least = brute_components(prints.values()), {}
            for i, p in prints.items():
                least[root[p]] = min(i, least.get(root[p], i))
            assert Counter(r["doc_id"] for r in after) == Counter(least.values())
        elif name == "mixing":
            words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
            assert abs(words(after) - 1.5 * words(before)) <= 0.001 * words(before) + 2
            texts = {r["doc_id"]: r["text"] for r in before}
            cut = [r for r in after if r["text"] != texts[r["doc_id"]]]
            assert len(cut) <= len({r["source"] for r in before}) and max(Counter(r["doc_id"] for r in after).values()) <= 2
            assert all(texts[r["doc_id"]].split()[: len(r["text"].split())] == r["text"].split() for r in cut)
        else:
            fill = Counter()
            for r in after:
                fill[r["sequence_id"]] += r["length"]
            assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) * 1.01 + 1
            pieces = Counter((r["doc_id"], r["piece"]) for r in after)
            assert {i for i, _ in pieces} == {r["doc_id"] for r in before}
        before = after


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
