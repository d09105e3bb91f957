import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import decontam


def test_documents_shorter_than_the_item(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, r.choices(vocabulary, k=n)) for i, n in enumerate([3, 5, 6, 10, 14, 24, 25, 40, 70, 90])]
    docs = []
    for i in range(160):
        w = list(r.choice(items)[1])
        for _ in range(r.choice([1, 1, 2, 3, 6, 12])):
            if w:
                del w[r.choice([0, -1, r.randrange(len(w))])]
        docs.append((i, w))

    def shingles(w, n):
        k = min(5, n)
        return [tuple(w[a:a + k]) for a in range(len(w) - k + 1)]
    want = {}
    for i, w in docs:
        for j, u in items:
            target, s = shingles(u, len(u)), shingles(w, len(u))
            m = min(len(target), len(s))
            best = max((sum((Counter(s[a:a + m]) & Counter(target)).values()) for a in range(len(s) - m + 1)), default=0)
            if best / (len(target) + m - best) >= 0.8:
                want[i, j] = best / (len(target) + m - best)
    assert len(want) > 50
    found = decontam.contaminations(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"),
                                    spark.createDataFrame([(j, " ".join(u)) for j, u in items], "item_id long, text string"), shorter=True)
    got = {(x.doc_id, x.item_id): x.s for x in found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("s")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
