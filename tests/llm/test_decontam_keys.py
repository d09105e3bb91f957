import random

from tidemark.llm import decontam


def leaks(spark, docs, items):
    out = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"),
                                 spark.createDataFrame(items, "item_id long, text string"))
    return {r.doc_id: r.item_ids if r.contaminated else None for r in out.collect()}


def test_items_that_share_an_id_or_are_long(spark):
    r = random.Random(8)
    passage = lambda n=30: " ".join(r.choices([f"w{k}" for k in range(500)], k=n))
    twice, one, two, none_, other = (passage() for _ in range(5))
    items = [(1, twice), (1, twice), (2, one), (2, two), (None, none_), (None, other), (3, " ".join(f"v{k}" for k in range(33_000)))]
    docs = [(k, f"before it {t} after it") for k, t in enumerate([twice, one, two, none_, other, passage()])]
    assert leaks(spark, docs, items) == {0: [1], 1: [2], 2: [2], 3: [], 4: [], 5: None}  # null ids are not listed


def test_counts_over_sixteen_bits(spark):
    rows = spark.createDataFrame([(1, [3 << 31 | 1] * 70_000 + [2] * 69_000)], "k int, s array<long>")
    assert decontam._with_fingerprint(rows, ["k"]).first().fp == 3 << 31 | 1
