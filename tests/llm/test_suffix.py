import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import suffix


def brute(texts, length, weights=None):
    seen = Counter()
    for t, w in zip(texts, weights or [1] * len(texts)):
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] += w
    return [[seen[t[i:i + length]] > 1 for i in range(max(0, len(t) - length + 1))] for t in texts]


@pytest.mark.parametrize("length,period", [(8, 4), (20, 5), (40, 20), (42, 7)])
def test_sorted_block_equals_brute_force(length, period):
    r = random.Random(length)
    cover = suffix.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    for letters in (b"ab", b"abcdefgh"):
        base = bytes(r.choices(letters, k=300))
        texts = [base[a:a + r.randint(0, 160)] for a in (r.randint(0, 200) for _ in range(14))] + [b"", b"a" * 90]
        texts += [bytes(r.choices(letters, k=70)) for _ in range(4)]
        weights = [r.choice([1, 1, 2]) for _ in texts]
        got = suffix.repeated_starts(texts, weights, length, period)
        assert [g.tolist() for g in got] == brute(texts, length, weights)


def test_anchors_depend_on_the_window_only(monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 64)
    r = random.Random(1)
    data = bytes(r.choices(b"abc", k=500))
    for skip in (None, 100):
        at, lo, hi, h = suffix.anchors(data, 40, 8, skip)
        assert lo[0] == 0 and hi[-1] == 460 and (lo[1:] == hi[:-1] + 1).all() and ((at >= lo - 0) & (at <= hi + 32)).all()
    at, lo, hi, h = suffix.anchors(data[30:], 40, 8)
    full = suffix.anchors(data, 40, 8)
    where = lambda found, p: next((int(a), int(k)) for a, x, y, k in found.T if x <= p <= y)
    for p in range(0, 420, 7):
        a, k = where(np.stack([at, lo, hi, h]), p)
        assert (a + 30, k) == where(full, p + 30)


@pytest.mark.parametrize("hot", [2, 4096])
def test_removed_bytes_equal_brute_force(spark, hot):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(8, 30))) for _ in range(6)]
    rows = [(i, " ".join(r.choice(passages) if r.random() < 0.2 else word() for _ in range(r.randint(1, 40)))) for i in range(80)]
    rows += [(80, "z" * 300), (81, None), (82, rows[3][1]), (82, rows[3][1])]
    length = 40
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, flags in zip(rows, texts, brute(texts, length)):
        gone = np.zeros(len(t), bool)
        for k in np.flatnonzero(flags):
            gone[k:k + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        want.append((i, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix.remove_repeated_strings(docs, length=length, period=10, gram=8, hot=hot).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in got) == sorted(want)


def removed(rows, length):
    out = []
    for (i, t), flags in zip(rows, brute([t.encode() for _, t in rows], length)):
        gone = np.zeros(len(t.encode()), bool)
        for k in np.flatnonzero(flags):
            gone[k:k + length] = True
        out.append((i, int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(t.encode(), np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def test_no_bucket_grows_with_the_documents_that_share_a_passage(spark, monkeypatch):
    """Passages a little shorter than the length, and a longer one, in many different texts."""
    hot, length, whole = 8, 40, suffix._sorted_buckets

    def watched(*args):
        run = whole(*args)

        def checked(batches):
            held = list(batches)
            sizes = Counter(k for b in held for k in b.column("bucket").to_pylist())
            assert max(sizes.values(), default=0) <= hot, max(sizes.values())
            yield from run(iter(held))
        return checked

    monkeypatch.setattr(suffix, "_sorted_buckets", watched)
    r = random.Random(5)
    text = lambda n: "".join(r.choices("abcdefghijklmnop ", k=n))
    passages = [text(n) for n in (24, 36, 39, 70)]
    rows = [(i, text(r.randint(30, 60)) + passages[i % 4] + text(r.randint(30, 60))) for i in range(240)]
    rows += [(300 + i, passages[1] * 3 + text(1) * 90) for i in range(6)] + [(400, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix.remove_repeated_strings(docs, length=length, period=10, gram=8, hot=hot).collect()
    assert sorted((x.doc_id, x.n_removed, hashlib.sha256(x.kept).hexdigest()) for x in got) == removed(rows, length)


def test_planted_passages_of_over_fifty_words_go_from_400_bytes_on(spark):
    r = random.Random(6)
    words = lambda n, k: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for _ in range(n))
    short, long_ = words(56, 6), words(58, 6)  # 391 and 405 bytes
    rows = [(i, words(40, 7)) for i in range(20)]
    rows += [(100 + i, f"{words(30, 7)}\n{short}\n{words(30, 7)}") for i in range(6)]
    rows += [(200 + i, f"{words(30, 7)}\n{long_}\n{words(30, 7)}") for i in range(6)]
    got = suffix.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_removed, hashlib.sha256(x.kept).hexdigest()) for x in got) == removed(rows, 400)
    assert {x.n_removed for x in got if x.doc_id < 200} == {0}
    assert min(x.n_removed for x in got if x.doc_id >= 200) == 407  # the line feeds around it repeat as well
