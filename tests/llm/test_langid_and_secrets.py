import re
import zlib

import numpy as np

from tidemark.llm import langid, secrets
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify_languages(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) / len(test) > 0.97


def test_bundle_is_the_sum_of_bound_ngrams():
    p = langid.Profiler(256, 1)
    (numbers, bundles), = p.bundles(["Ab, cé", "12", "b"])
    assert numbers == [0, 2]
    v = lambda c: p.vectors.letter(ord(c)).astype(int)
    want = sum(v(a) * np.roll(v(b), 1) * np.roll(v(c), 2) for a, b, c in (" ab", "ab ", " cé", "cé "))
    assert (bundles[0] == want).all() and (bundles[1] == v(" ") * np.roll(v("b"), 1) * np.roll(v(" "), 2)).all()


def test_a_long_text_in_parts(monkeypatch):
    texts = ["The river walks under stone. " * 40, "x", "Zu und der. " * 30]
    whole = {}
    for numbers, rows in langid.Profiler(128, 1).bundles(texts):
        whole |= dict(zip(numbers, rows))
    monkeypatch.setattr(langid, "GROUP_CHARS", 290)  # cut between words, so no n-gram is lost
    parts = {}
    for numbers, rows in langid.Profiler(128, 1).bundles(texts):
        for i, b in zip(numbers, rows):
            parts[i] = parts.get(i, 0) + b
    assert parts.keys() == whole.keys() and all(np.dot(parts[i], whole[i]) > 0.99 * np.linalg.norm(parts[i]) * np.linalg.norm(whole[i]) for i in whole)


def test_findings_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 3000")
    found = secrets.scan_secrets(docs, train_on=~langid.held_out(F.col("doc_id"))).filter("score > 0.5")
    got = {(r.doc_id, r.value) for r in found.select("doc_id", "value").collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        for m in re.finditer(r"(?<!\S)(?:(AKIA[0-9A-Z]{16})|password=([0-9a-f]{18})|token = \"([0-9a-f]{40})\")", r.text):
            want.add((r.doc_id, m[1] or m[2] or m[3]))
    assert len(want) > 20
    held = lambda s: {x for x in s if zlib.crc32(str(x[0]).encode()) % 3 == 1}
    assert len(held(want) & got) >= 0.95 * len(held(want)) and len(held(got) - want) <= 0.1 * len(held(got))
