import random

import corpus_pipeline
from tidemark.llm.near import near_duplicates


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """Brute force: the least (id, text) of each component."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        return x if root[x] == x else top(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r), r)
    return set(least.values())


def test_copies_at_similarity_0_8_go(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(900)]
    line = r.choices(vocabulary, k=12)
    base = [r.choices(vocabulary, k=r.choice([4, 9, 60, 200, 400])) + line for _ in range(25)]
    texts = []
    for i in range(260):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 4, 6, 9])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(texts))] + [(3, "Two different texts of one id and no copy of another."), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(x.doc_id, x.text) for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == survivors(rows[:-1]) | {rows[-1]} and len(got) < 200


def test_near_copies_beyond_three_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id IN (783, 3006, 596, 917, 1, 2)")
    assert {x.doc_id for x in near_duplicates(docs).collect()} == {3006, 917}
