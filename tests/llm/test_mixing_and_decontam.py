import random
from collections import Counter

import regex

from tidemark.llm import decontam, mixing
from pyspark.sql import functions as F


def targets(sizes):
    """Repeated resharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mix_of_skewed_sources(spark):
    r = random.Random(7)
    names = ["big"] * 400 + [None] * 60 + ["é"] * 30 + [f"s{k}" for k in range(40) for _ in range(r.randint(1, 12))] + ["empty"] * 3
    rows = [(i, s, None if s == "empty" else "w " * r.randint(1, 60)) for i, s in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.mix_sources(docs, blocks=64)
    got = mixed.collect()
    size = {i: (t or "").count("w") for i, _, t in rows}
    per = Counter()
    for i, s, _ in rows:
        per[s] += size[i]
    want, source, taken = targets(per), {i: s for i, s, _ in rows}, Counter()
    for x in got:
        assert x["size"] == size[x.doc_id] and x.source_size == per[source[x.doc_id]]
        assert abs(x.target - want[source[x.doc_id]]) < 1e-6 and x.taken <= 2 * x["size"] and x.taken % max(1, x["size"]) == 0
        taken[source[x.doc_id]] += x.taken
    assert all(abs(taken[s] - want[s]) <= 30.5 for s in per)  # half of the longest document
    again = mixing.mix_sources(docs.repartition(7), blocks=64).collect()
    assert {x.doc_id: x.draws for x in again} == {x.doc_id: x.draws for x in got}
    shards = Counter(x["shard"] for x in mixing.mixture(mixed).collect())
    assert set(shards) == set(range(16)) and sum(shards.values()) == sum(len(x.draws) for x in got)


def test_quotas_split_exactly(spark):
    quota = {0: 101, 1: 7, 2: 1, 3: 300}
    got = mixing.split_quotas(spark.createDataFrame(list(quota.items()), "number long, quota long"), 3).collect()
    by_source, by_shard = Counter(), Counter()
    for x in got:
        by_source[x.number] += x.quota
        by_shard[x["shard"]] += x.quota
    assert by_source == quota and set(by_shard) == set(range(8)) and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_contaminations_equal_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 5, 12, 40, 70])))) for i in range(14)]
    rows = []
    for i in range(150):
        words = r.choices(vocabulary, k=r.randint(0, 120))
        if r.random() < 0.6:
            w = r.choice(items)[1].split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                k = r.randrange(len(w))
                w[k:k + r.choice([0, 1])] = r.choice([[], [r.choice(vocabulary)]])
            at = r.randint(0, len(words))
            words[at:at] = w
        rows.append((i, ", ".join(words).upper()))
    words_of = lambda t: regex.findall(r"[\p{L}\p{N}]+", t.lower())

    def shingles(w, n):
        k = min(5, n)
        return [tuple(w[a:a + k]) for a in range(len(w) - k + 1)]
    want = {}
    for i, t in rows:
        for j, u in items:
            target = shingles(words_of(u), len(words_of(u)))
            s, m = shingles(words_of(t), len(words_of(u))), len(target)
            count = Counter(target)
            best = max((sum((Counter(s[a:a + m]) & count).values()) for a in range(len(s) - m + 1)), default=0)
            if best / (2 * m - best) >= 0.8:
                want[i, j] = best / (2 * m - best)
    found = decontam.contaminations(spark.createDataFrame(rows, "doc_id long, text string"),
                                    spark.createDataFrame(items, "item_id long, text string"))
    got = {(x.doc_id, x.item_id): x.s for x in found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("s")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 30
