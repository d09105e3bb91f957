"""Near duplicates of word shingles: candidates by least hashes and SimHash, links by exact similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HOT_SHARE, attach, id_and_text, stage
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import BATCH_ROWS, BUCKET_ROWS, _tiles, majority, near_pairs, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
LEAST = 10  # two sets at 0.8 share none of their ten least hashes with a chance of 1e-7
RADIUS, WIDE = 24, 42  # bits of 64 and of 128; sets at 0.8 lie beyond with a chance of 3e-6 and 2e-7
PART = 1 << 17
SKETCH_BYTES = 512  # of a set's bitmap: bit h % 4096 for each hash h
HOT_BYTES = 64 << 20
PAIRS_AT_ONCE = 1 << 14


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles (ASCII lowered, cut at white space)."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _print(s: np.ndarray) -> int:
    return majority(s[k:k + PART] for k in range(0, len(s), PART))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes independent of h, for the second fingerprint."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(SKETCH_BYTES * 8, np.uint8)
    bits[(s >> np.uint64(20)).astype(np.int64) % (SKETCH_BYTES * 8)] = 1
    return np.packbits(bits).tobytes()


def sketches(rows: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """(doc_id, text_hash, text) -> doc_id, text_hash, node (hash of the set), fp, fp2, size, bitmap, least hashes."""
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.record_batch([
                b.column("doc_id"), b.column("text_hash"), signed([xxhash.xxh64_intdigest(s.tobytes()) for s in sets]),
                signed([_print(s) for s in sets]), signed([_print(_mixed(s)) for s in sets]),
                pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_bitmap, sets), pa.binary()),
                pa.array([s[:least].view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "node", "fp", "fp2", "size", "bitmap", "least"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text_hash", "text").mapInArrow(
        run, f"doc_id {kind}, text_hash bigint, node bigint, fp bigint, fp2 bigint, size bigint, "
             "bitmap binary, least array<bigint>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, n, text) -> (node, n, s)."""
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("node"), b.column("n"), pa.array(sets, pa.list_(pa.int64()))],
                                  names=["node", "n", "s"])
    return texts.select("node", "n", "text").mapInArrow(run, "node bigint, n bigint, s array<bigint>")


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, words: int, similarity: float, many: bool) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have this Jaccard similarity; sets are made of their texts only.

    many: the nodes grow with the corpus, so they are never broadcast to the texts, not even where they are few."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    wanted = stage(classes.select("node", "first.*").join(ends, "node").withColumnsRenamed(
        {"doc_id": "_d", "text_hash": "_h"}), "wanted")
    texts = rows.join(wanted.hint("merge") if many else wanted, (F.col("doc_id") == F.col("_d")) & (F.col("text_hash") == F.col("_h")))
    sets = stage(_sets(texts, words), "sets").dropDuplicates(["node"])
    sets = stage(sets, "distinct-sets")
    one = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"))
    other = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"))
    both = _attached(_attached(pairs, one, "b", "n_b", "s_b", "a"), other, "a", "n_a", "s_a", "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    both = both.withColumn("shared", shared).filter(
        F.col("shared") / (F.size("s_a") + F.size("s_b") - F.col("shared")) >= similarity)
    return stage(both.select("a", "b"), "links")


def _attached(pairs: DataFrame, sets: DataFrame, key: str, size: str, held: str, spread: str) -> DataFrame:
    """The sets of one end beside the pairs. Hot nodes' sets are broadcast while their bytes stay within the
    bound; beyond it the join shuffles, and adaptive execution splits the hot nodes."""
    total = sets.agg(F.sum(size)).first()[0] or 0
    heavy = sets.filter(F.col(size) * HOT_SHARE > total).agg(F.sum(F.size(held))).first()[0] or 0
    if heavy * 8 <= HOT_BYTES:
        return attach(pairs, sets, key, size, spread)
    return pairs.join(sets, key, "left")


def _candidates(part: dict[str, np.ndarray], ends: np.ndarray, similarity: float, forest: bool):
    """Pairs (greater, lesser node) of different labels within their buckets that may be alike.

    SimHash first, then the bitmaps: the bits in which two differ are never more than the elements in
    which the sets differ, so no pair at the similarity is lost, and for sets of some hundreds few others
    pass. With forest, a pair whose labels are connected by pairs given before is left out: at most as many
    pairs as nodes come from each bucket.
    """
    node, size, maps = part["node"], part["words"], part["bitmap"]
    label = np.unique(part["label"], return_inverse=True)[1]
    # within a bucket only, as the batch holds several: labels are told apart by bucket
    label = np.unique(np.stack([ends, label]), axis=1, return_inverse=True)[1].reshape(-1)
    root = np.arange(len(part["node"]))
    for i, j in near_pairs(part["fp"].view(np.uint64), ends, RADIUS):
        for k in range(0, len(i), PAIRS_AT_ONCE):
            x, y = i[k:k + PAIRS_AT_ONCE], j[k:k + PAIRS_AT_ONCE]
            ok = (root[label[x]] != root[label[y]]) & (
                np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9)
            x, y = x[ok], y[ok]
            near = sum(np.bitwise_count((part[f][x] ^ part[f][y]).view(np.uint64)).astype(int) for f in ("fp", "fp2"))
            x, y = x[near <= WIDE], y[near <= WIDE]
            differ = np.bitwise_count(maps[x] ^ maps[y]).sum(1, dtype=np.int64)
            ok = differ * (1 + similarity) <= (1 - similarity) * (size[x] + size[y]) + 1e-9
            x, y = x[ok], y[ok]
            if forest:
                new = []
                for at, (a, b) in enumerate(zip(label[x].tolist(), label[y].tolist())):
                    while root[a] != a:
                        a = root[a]
                    while root[b] != b:
                        b = root[b]
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        new.append(at)
                while (root[root] != root).any():
                    root = root[root]
                x, y = x[new], y[new]
            yield np.maximum(node[x], node[y]), np.minimum(node[x], node[y])


def _candidate_batches(similarity: float, forest: bool):
    """Rows sorted by tile -> (a, b); a tile's rows are gathered, as many as two parts of a bucket hold."""
    names = ["node", "fp", "fp2", "words", "label"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table):
            tile = rows.column("tile").to_numpy()
            starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
            ends = np.repeat(np.r_[starts[1:], len(tile)], np.diff(np.r_[starts, len(tile)]))
            part = {c: rows.column(c).to_numpy().copy() for c in names}
            part["bitmap"] = np.frombuffer(b"".join(rows.column("bitmap").to_pylist()), np.uint64).reshape(len(tile), -1)
            for a, b in _candidates(part, ends, similarity, forest):
                if len(a):
                    yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BATCH_ROWS:  # all but the last, perhaps unfinished tile
                rows = pa.Table.from_batches(held)
                tile = rows.column("tile").to_numpy()
                cut = int(np.searchsorted(tile, tile[-1]))
                held = rows.slice(cut).to_batches()
                if cut:
                    yield from flush(rows.slice(0, cut))
        if sum(x.num_rows for x in held):
            yield from flush(pa.Table.from_batches(held))
    return run


def _bucket_pairs(rows: DataFrame, maps: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """Candidates (a, b) between nodes of one bucket with different labels; rows (bucket, node, fp, fp2, words, label)."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("label").alias("x"), F.max("label").alias("y"))
    open_ = attach(rows, stage(sizes.filter("x <> y").select("bucket", "size"), "mixed"), "bucket", "size", "node")
    open_ = open_.filter("size IS NOT NULL").join(maps, "node")
    tiles = _tiles(open_, ["node", "fp", "fp2", "words", "label", "bitmap"], BUCKET_ROWS)
    return tiles.mapInArrow(_candidate_batches(similarity, forest), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash) of the rows that a smaller (doc_id, text_hash) stands for: all but the least
    of each component of texts linked by a Jaccard similarity of their shingle sets of `similarity` or more.

    Sets that share one of their ten least hashes meet in that hash's bucket. They are compared by SimHash (over
    the sets; 64 bits in bit-sliced tiles, then 128) and by bitmaps of the sets: first the pairs of a spanning
    forest of each bucket, so a large group of near copies gives as many pairs as it has texts; then, between
    the components those leave apart, all pairs. Every pair is verified by its sets. Null ids are left
    out; a text without words equals another.
    """
    rows = id_and_text(docs, id_col, text_col).filter("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    found = stage(sketches(rows, words), "sketches")
    classes = stage(found.groupBy("node").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n")), "classes")
    nodes = stage(found.select("node", "fp", "fp2", F.col("size").alias("words"), "bitmap", "least").dropDuplicates(["node"]), "nodes")
    held, maps = nodes.select(F.explode("least").alias("bucket"), "node", "fp", "fp2", "words"), nodes.select("node", "bitmap")
    tried = stage(_bucket_pairs(held.withColumn("label", F.col("node")), maps, similarity, True), "forest")
    labels = stage(connected_components(verified(tried, rows, classes, words, similarity, many=True)), "labels")
    named = stage(held.join(labels, "node", "left").select(*held.columns, F.coalesce("component", "node").alias("label")), "labelled")
    apart = stage(_bucket_pairs(named, maps, similarity, False).join(tried, ["a", "b"], "left_anti"), "apart")
    links = verified(apart, rows, classes, words, similarity, many=False)
    if not links.isEmpty():
        # components of components: the links found last, between the labels found first
        of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
        between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
            F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        above = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("above"))
        ends = classes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        labels = stage(ends.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component")), "labels")
    classes = stage(classes.join(labels, "node", "left").select(
        "node", "first", "n", F.coalesce("component", "node").alias("component")), "named")
    groups = stage(classes.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("size")), "groups")
    classes = stage(attach(classes.select("node", "n", "component"), groups, "component", "size", "node").select(
        "node", "n", "least"), "least")
    out = attach(found.select("doc_id", "text_hash", "node"), classes, "node", "n", "doc_id")
    return out.filter(F.struct("doc_id", "text_hash") != F.col("least")).select("doc_id", "text_hash").distinct()
