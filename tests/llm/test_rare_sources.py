"""Rare sources beside a hot one give their targets."""

from collections import Counter, defaultdict

from test_text_operators import rows

from rasterfold.llm import mixing


def test_rare_sources_reach_their_targets(make_docs):
    hot = [(i, "w " * 2000, "hot") for i in range(60)]
    rare = [(1000 + i, "w " * (1 + i % 5), f"rare{i // 4}") for i in range(80)]
    docs = make_docs([*hot, *rare, (5000, "a b c", None)])
    options = {"blocks": 256}
    target, size = {}, defaultdict(int)
    for r in rows(mixing.mix(docs, **options)):
        target[r["source"]] = r["target"]
        size[r["source"]] += r["size"]
    words = Counter()
    for r in rows(mixing.mixed(docs, **options)):
        words[r["source"]] += len(r["text"].split())
    assert len(target) == 22 and all(abs(words[s] - t) < 1 for s, t in target.items())
    assert all(words[s] <= 2 * n for s, n in size.items())
    assert abs(sum(words.values()) - 1.5 * sum(size.values())) <= 1


def test_no_source_is_lost(spark):
    """Many small sources, and one small one beside a large one, near their targets; shards keep the proportions."""
    from pyspark.sql import functions as F

    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 20).alias("text"), F.format_string("s%05d", "id").alias("source"))
    two = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") == 7, 30).otherwise(2000)).alias("text"), F.when(F.col("id") == 7, "small").otherwise("large").alias("source"))
    for docs, sources in ((many, 30_000), (two, 2)):
        mixed = mixing.mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.sum("size").alias("size")).toPandas()
        assert len(mixed) == sources and (abs(mixed["taken"] - mixed["target"]) <= 1 + mixed["target"] / 64).all() and (mixed["taken"] <= 2 * mixed["size"]).all()
        assert abs(mixed["taken"].sum() - 1.5 * mixed["size"].sum()) <= 1 + mixed["size"].sum() / 10_000
    parts = mixing.mix(two).select("doc_id", "size", "taken", "source", F.explode("parts").alias("p")).select("*", "p.*").toPandas()
    shards = parts[parts["source"] == "large"].groupby("shard")["words"].sum()
    assert len(shards) == mixing.SHARDS and shards.max() - shards.min() <= 0.01 * shards.max() + 200
    assert (parts["start"] + parts["words"] <= parts["size"]).all() and (parts.groupby("doc_id")["words"].sum() == parts.groupby("doc_id")["taken"].first()).all()


def brute_mix(docs, blocks, shards, fineness):
    """(doc_id, taken, first shard) by awarding block after block at the highest quotient."""
    import hashlib
    import math

    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(sizes.values()) * 1.5
    target, open_ones = {}, set(names)
    while open_ones:
        rest, w = total - sum(target.values()), sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if rest * weight[s] / w > 2 * sizes[s]}
        if not full:
            target |= {s: rest * weight[s] / w for s in open_ones}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ones -= full
    size = max(1, min(math.floor(total / blocks), math.floor(min(t for t in target.values() if t > 0) / fineness)))
    won = {s: [0] * (shards + 1) for s in names}
    for s in names:
        for i in range(1, 2 * sizes[s] // size + 1):
            for k in range(1, shards + 1):
                won[s][k] += target[s] / (2 * i - 1) >= size * shards / k / 2 * (1 - 1e-12)
    missing = math.floor(total / size) - sum(w[-1] for w in won.values())
    step = 1 if missing > 0 else -1
    able = [s for s in names if (won[s][-1] < 2 * sizes[s] // size and target[s] > 0 if step > 0 else won[s][-1] > 0)]
    for s in sorted(able, key=lambda s: (-step * target[s] / (2 * won[s][-1] + step), names.index(s)))[: abs(missing)]:
        won[s][-1] += step
    out = []
    for s in names:
        own = sorted((hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest(), i, len((t or "").split())) for i, t, x in docs if x == s)
        stream = [(i, n) for _, i, n in own for _ in range(n)]
        taken, first = Counter(), {}
        for at in range(won[s][-1] * size):
            i = stream[at % len(stream)][0]
            taken[i] += 1
            first.setdefault(i, sum(min(e, won[s][-1]) * size <= at for e in won[s][1:-1]))
        out += [(i, taken[i], first.get(i)) for _, i, _ in own]
    return out


def test_against_awards_one_by_one(make_docs):
    docs = [(i, "w " * (i * 7 % 23), ("a", "b", "c", "d", None)[(i * i) % 5]) for i in range(150)]
    for blocks, shards, fineness in ((16384, 16, 64), (40, 4, 2), (10, 3, 1)):
        got = [(r["doc_id"], r["taken"], r["parts"][0]["shard"] if r["parts"] else None) for r in rows(mixing.mix(make_docs(docs), blocks=blocks, shards=shards, fineness=fineness))]
        assert sorted(got) == sorted(brute_mix(docs, blocks, shards, fineness))
