"""SimHash near-duplicates: exact Hamming links found by bit-sliced comparison inside banded buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, id_and_text, stage, word_blocks
from tidemark.llm.components import connected_components

BITS, SEED = 64, 42
BUCKET_ROWS = 4096  # a larger bucket is compared in tiles of two parts
BATCH_ROWS = 1 << 16
PLANES_A_TEST = 8


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles, part by part; a text of fewer words is one shingle, one without words none."""
    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    found, last = False, []
    for block in word_blocks(text.encode().lower()):
        w = last + block.split()
        last = w[-(words - 1):] if words > 1 else []
        if len(w) < words:
            last = w
            continue
        found = True
        yield np.fromiter(map(hashed, map(b" ".join, zip(*(w[i:] for i in range(words))))), np.uint64)
    if last and not found:
        yield np.array([hashed(b" ".join(last))], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """Bit i is set if over half of the hashes have it; no hashes: 0."""
    counts, total = np.zeros(BITS, np.int64), 0
    for h in parts:
        counts += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"),
                                axis=0, dtype=np.int32)
        total += len(h)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, words: int = 3) -> int:
    """Bit i is set if over half of the shingles' hashes have it; no words: 0."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp bigint), over whole texts."""
    def run(batches):
        for b in batches:
            values = [fingerprint(t, words) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(np.array(values, np.uint64).view(np.int64))],
                                  names=["doc_id", "fp"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _packed(flags: np.ndarray, words: int) -> np.ndarray:
    """Boolean rows along the last axis -> 64-bit words, bit k of word w is element 64 w + k."""
    out = np.zeros((*flags.shape[:-1], words * 8), np.uint8)
    packed = np.packbits(flags, axis=-1, bitorder="little")
    out[..., : packed.shape[-1]] = packed
    return out.view(np.uint64)


def near_pairs(fps: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j < ends[i], at most radius bits apart.

    Plane p holds bit p of all fingerprints. Row i is compared with row i + d for all i at once, a
    word of 64 pairs at a time: the differing bits of one plane are added to bit-sliced counters by
    carry-save steps, and words in which every pair has passed the radius are dropped.
    """
    n = len(fps)
    words = -(-n // 64)
    planes = _packed(np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T, 2 * words + 2)
    index, digits = np.arange(n), max(1, int(radius).bit_length())
    for d in range(1, int((ends - index).max(initial=0))):
        inside = index + d < ends
        if not inside.any():
            return
        valid = _packed(inside, words)
        at = np.flatnonzero(valid)
        valid, (q, s) = valid[at], divmod(d, 64)
        counter, over = [np.zeros(len(at), np.uint64) for _ in range(digits)], np.zeros(len(at), np.uint64)
        for first in range(0, BITS, PLANES_A_TEST):
            for plane in planes[first: first + PLANES_A_TEST]:
                other = plane[at + q] if not s else (
                    plane[at + q] >> np.uint64(s) | plane[at + q + 1] << np.uint64(64 - s))
                carry = plane[at] ^ other
                for k in range(digits):
                    counter[k], carry = counter[k] ^ carry, counter[k] & carry
                over |= carry
            above, equal = np.zeros_like(over), ~np.zeros_like(over)
            for k in reversed(range(digits)):  # counter > radius, digit by digit
                if radius >> k & 1:
                    equal &= counter[k]
                else:
                    above |= equal & counter[k]
                    equal &= ~counter[k]
            valid &= ~(over | above)
            alive = valid != 0
            if not alive.all():
                at, valid, over = at[alive], valid[alive], over[alive]
                counter = [c[alive] for c in counter]
                if not len(at):
                    break
        if len(at):
            word, bit = np.nonzero(np.unpackbits(valid.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = at[word] * 64 + bit
            yield i, i + d


def stars(nodes: np.ndarray, fps: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of a batch as (node, least row of its local component): as many rows as nodes at most."""
    root = np.arange(len(fps))
    for i, j in near_pairs(fps, ends, radius):
        a, b = root[i], root[j]
        for x, y in zip(a[a != b].tolist(), b[a != b].tolist()):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root = root[root]
    linked = np.flatnonzero(root != np.arange(len(root)))
    return nodes[linked], nodes[root[linked]]


def _link_batches(compare: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], batch_rows: int):
    """Rows of bigints, sorted by the first (the bucket) -> (a, b) of compare(rows, ends of their buckets)."""
    def run(batches):
        held: list[np.ndarray] = []

        def flush(part: np.ndarray):
            starts = np.flatnonzero(np.r_[True, (part[1:, 0] != part[:-1, 0])])
            ends = np.repeat(np.r_[starts[1:], len(part)], np.diff(np.r_[starts, len(part)]))
            a, b = compare(part, ends)
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            held.append(np.stack([b.column(k).to_numpy() for k in range(b.num_columns)], axis=1))
            if sum(map(len, held)) >= batch_rows:  # all but the last, perhaps unfinished bucket
                rows = np.concatenate(held)
                cut = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1 if (rows[:, 0] != rows[-1, 0]).any() else 0
                held = [rows[cut:]]
                if cut:
                    yield flush(rows[:cut])
        if held and sum(map(len, held)):
            yield flush(np.concatenate(held))
    return run


def band_keys(fp: Column, radius: int, kept: int) -> Column:
    """One key for each choice of `kept` of radius + kept bands: fingerprints within the radius agree in one."""
    bands = radius + kept
    edges = [BITS * k // bands for k in range(bands + 1)]
    keys = []
    for table, choice in enumerate(combinations(range(bands), kept)):
        mask = sum(((1 << edges[k + 1]) - 1) & ~((1 << edges[k]) - 1) for k in choice)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.xxhash64(F.lit(table), fp.bitwiseAND(F.lit(mask).cast("long"))))
    return F.array(*keys)


def _tiles(rows: DataFrame, columns: list[str], bucket_rows: int) -> DataFrame:
    """rows (bucket, size, fp, columns) -> (tile, columns) with each tile together in a task."""
    parts = F.ceil(F.col("size") / bucket_rows).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = rows.withColumn("parts", parts).withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select(
        F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), *columns)
    return tiles.repartition("tile").sortWithinPartitions("tile")


def hamming_links(nodes: DataFrame, radius: int = 3, kept: int = 2, bucket_rows: int = BUCKET_ROWS,
                  batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(node bigint, fp bigint distinct) -> (a, b) links that span the same components as all pairs
    within the radius.

    Buckets are the band tables' keys (2 of 5 bands: ten tables of about 26 bits). A bucket of more
    than bucket_rows is cut into parts by hash, and each pair of parts is a tile of its own, so no
    task holds more than two parts.
    """
    rows = stage(nodes.select("node", "fp", F.explode(band_keys(F.col("fp"), radius, kept)).alias("bucket")), "bands")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    rows = attach(rows, stage(sizes, "buckets"), "bucket", "size", "node").filter("size IS NOT NULL")
    compare = lambda part, ends: stars(part[:, 1].copy(), part[:, 2].copy().view(np.uint64), ends, radius)
    return _tiles(rows, ["node", "fp"], bucket_rows).mapInArrow(_link_batches(compare, batch_rows), "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                       radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of at most
    radius bits), class_size (documents of the same fingerprint).

    Null text is empty; a text without words has fingerprint zero and links like any other. Rows
    with a null id get a fingerprint, but no component (null). Repeated rows are returned as often.
    """
    prints = stage(fingerprints(id_and_text(docs, id_col, text_col), words), "fingerprints")
    classes = stage(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(
        F.min("doc_id").cast("long").alias("node"), F.count("*").alias("class_size")), "classes")
    labels = connected_components(hamming_links(classes.select("node", "fp"), radius))
    named = classes.join(labels, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id"), "class_size")
    out = attach(prints, stage(named, "named"), "fp", "class_size", "doc_id")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.when(known, F.col("component_id")).alias("component_id"),
                      F.when(known, F.col("class_size")).alias("class_size"))
