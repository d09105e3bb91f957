import random

import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import connected_components


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_hubs_and_random_edges(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(1000, 1080)] + [(5, i) for i in range(2000, 2300)] + [(7, 7)]
    edges += [(r.randint(0, 400), r.randint(0, 400)) for _ in range(170)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union(edges, {n for e in edges for n in e})
    assert {n: got.get(n, n) for n in want} == want


def naive(text, words=3):
    w = text.encode().lower().split()
    s = [b" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprint_of_whole_texts():
    r = random.Random(4)
    for n in (0, 1, 2, 3, 4, 50, 2000):
        text = " ".join(r.choice(["Ab", "é", "x y", " ", "c"]) + r.choice(["", "\n", "\x0b", "  "]) for _ in range(n))
        assert simhash.fingerprint(text) == naive(text)
    long_ = " ".join(f"w{i * i % 9973}" for i in range(300_000))
    assert simhash.fingerprint(long_) == naive(long_)


def test_bit_sliced_pairs_equal_brute_force():
    r = np.random.default_rng(6)
    for radius in (0, 1, 3, 5, 8):
        base = r.integers(0, 1 << 63, 12, dtype=np.uint64)
        fps = base[r.integers(0, 12, 300)]
        for k in range(radius + 1):
            fps ^= np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)
        ends = np.sort(r.choice(300, 9, replace=False))
        ends = np.array([*(next(int(e) for e in [*ends, 300] if e > i) for i in range(300))])
        got = {(int(a), int(b)) for i, j in simhash.near_pairs(fps, ends, radius) for a, b in zip(i, j)}
        want = {(i, j) for i in range(300) for j in range(i + 1, ends[i]) if bin(int(fps[i] ^ fps[j])).count("1") <= radius}
        assert got == want


def test_links_with_tiles_and_many_batches(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = set()
    while len(fps) < 600:
        x = r.choice(base)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    nodes = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    links = simhash.hamming_links(spark.createDataFrame(nodes, "node long, fp long"), bucket_rows=7, batch_rows=50).collect()
    near = [(a, b) for a, x in nodes for b, y in nodes if a < b and bin((x ^ y) & (2**64 - 1)).count("1") <= 3]
    ids = [i for i, _ in nodes]
    assert union([(x.a, x.b) for x in links], ids) == union(near, ids)


def test_components_of_documents(spark, small):
    rows = [(x.doc_id, x.text) for x in small.select("doc_id", "text").collect()][:150]
    long_ = max(rows, key=lambda x: len(x[1]))[1]
    rows += [(1000, long_ + " more"), (1001, long_ + " more words"), (1002, rows[0][1].upper()), (1003, "  "), (1004, "")]
    got = {x.doc_id: x for x in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: naive(t) for i, t in rows}
    near = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    want = union(near, prints)
    assert {i: int(x.fingerprint, 16) for i, x in got.items()} == prints
    assert {i: x.component_id for i, x in got.items()} == want
