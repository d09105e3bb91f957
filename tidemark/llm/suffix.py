"""Repeated byte strings by difference-cover suffix sorting, one bucket of suffixes at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, id_and_text, stage

LENGTH, PERIOD, GRAM = 400, 20, 64
CHUNK = 1 << 20  # starts looked at together within one text
BLOCK_BYTES = 1 << 21  # text of the buckets sorted together
HOT_BUCKET = 512  # different contexts of one least gram; a larger bucket is cut
BLOCKS = (64, 16, 4, 1)  # starts that stay together when it is, one after the other
ROWS = 1 << 17  # anchors written at once
POSITION_BITS = 21
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences are all residues: any two positions have a common
    shift, below the period, that takes both into the set."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError(period)


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(keys.shape).astype(np.int64)


def _paired(ranks: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of (string, string `shift` further on) along the last axis."""
    a, b = ranks[..., : ranks.shape[-1] - shift], ranks[..., shift:]
    return _ranked(a * (int(b.max(initial=0)) + 1) + b)


def _short_ranks(text: np.ndarray, width: int) -> np.ndarray:
    """Rank of the `width` bytes at each position, by doubling."""
    done = 8 if width >= 8 else 1
    if done == 8:
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)).view(">u8").ravel()
        ranks = _ranked(words)
    else:
        ranks = text.astype(np.int64)
    while done < width:
        step = min(done, width - done)
        ranks = _paired(ranks, step)
        done += step
    return ranks


def repeated_starts(texts: list[bytes], weights: list[int], length: int = LENGTH, period: int = PERIOD) -> list[np.ndarray]:
    """For each text, which starts begin a `length`-byte string that occurs at least twice, texts
    counted by their weights.

    Suffixes are sorted by their first and last `period` bytes. Ties are resolved by the ranks of
    the cover sample (positions whose residue lies in the difference cover), made beforehand: two
    tied suffixes are equal if and only if the sample ranks at their common shift are.
    """
    if length % period or length < 2 * period:
        raise ValueError("the length must be a multiple of the period, twice it at least")
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begin[owner]
    hit = np.zeros(len(starts), bool)
    if len(starts):
        text = np.frombuffer(b"".join(texts), np.uint8)
        weight = np.asarray(weights, np.float64)[owner]
        short = _short_ranks(text, period)
        first, last = short[starts], short[starts + length - period]
        base = _ranked(first * (int(short.max()) + 1) + last)
        tied = np.flatnonzero(np.bincount(base, weight)[base] > 1)
        if len(tied):
            hit[tied] = _resolve_ties(short, starts[tied], base[tied], weight[tied], length, period)
    return np.split(hit, np.cumsum(counts)[:-1])


def _resolve_ties(short, starts, base, weight, length, period) -> np.ndarray:
    cover = difference_cover(period)
    columns = -(-len(short) // period)
    sample = np.zeros((len(cover), columns), np.int64)
    for row, residue in enumerate(cover):
        values = short[residue::period]
        sample[row, : len(values)] = values
    blocks, done = length // period - 1, 1  # the sample's strings reach to the last period bytes
    while done < blocks:
        step = min(done, blocks - done)
        sample = _paired(sample, step)
        done += step
    row_of = np.full(period, -1)
    row_of[list(cover)] = np.arange(len(cover))
    shifts = np.array([sorted((c - r) % period for c in cover) for r in range(period)])
    at = starts + shifts[starts % period].T  # every shift that takes a start into the sample
    rank = sample[row_of[at % period], at // period]
    key = (base * (int(sample.max()) + 1) + rank) * period + (at - starts)
    same = _ranked(key)
    return (np.bincount(same.ravel(), np.broadcast_to(weight, same.shape).ravel())[same] > 1).any(axis=0)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (BASE, inverse))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    up, down = _powers(CHUNK + 4096)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1] * np.uint64(MIX)
        h ^= h >> np.uint64(32)
        return h * np.uint64(MIX)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values in a row, by prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1: n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM, skip: int | None = None):
    """(at, lo, hi, hash): windows that start in lo..hi have their least gram at `at`.

    Equal windows have their least gram at the same place, so they meet under its hash. `skip` is a
    position that doesn't count, for the second least.
    """
    out = [np.zeros((4, 0), np.int64)]
    mask = np.uint64((1 << POSITION_BITS) - 1)
    whole = np.frombuffer(data, np.uint8)
    for c in range(0, len(data) - length + 1, CHUNK):
        part = whole[c: c + CHUNK + length - 1]
        h = _gram_hashes(part, gram)
        order = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        if skip is not None and 0 <= skip - c < len(order):
            order[skip - c] |= ~mask
        at = (_least(order, length - gram + 1) & mask).astype(np.int64)
        lo = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        hi = np.append(lo[1:], len(at)) - 1
        out.append(np.stack([at[lo] + c, lo + c, hi + c, h[at[lo]].view(np.int64)]))
    return np.concatenate(out, axis=1)


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _anchor_rows(length: int, gram: int):
    """Windows of one anchor, with a digest of their bytes as `context`."""
    def batch(docs, of: list[int], found: list[np.ndarray], digests: list[bytes]):
        row = pa.array(np.repeat(of, [f.shape[1] for f in found]).astype(np.int64))
        at, lo, hi, h = np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1)
        return pa.record_batch([*(docs.column(k).take(row) for k in ("doc_id", "text_hash")), pa.array(at), pa.array(lo),
                                pa.array(hi), pa.array(h), pa.array(digests, pa.binary())],
                               names=["doc_id", "text_hash", "at", "lo", "hi", "gram", "context"])

    def run(batches):
        for b in batches:
            of, found, digests = [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                data = text.encode()
                f = anchors(data, length, gram)
                of.append(k)
                found.append(f)
                digests += [_digest(data[lo: hi + length]) for lo, hi in f[1:3].T.tolist()]
                if len(digests) > ROWS:
                    yield batch(b, of, found, digests)
                    of, found, digests = [], [], []
            yield batch(b, of, found, digests)
    return run


def _collector(fields: list[tuple[str, pa.DataType]]):
    """(add: takes a row and its bytes, true when a batch is full; record: the batch so far)."""
    out: list[list] = [[] for _ in fields]
    size = 0

    def record():
        nonlocal out, size
        made = pa.record_batch([pa.array(values, kind) for values, (_, kind) in zip(out, fields)], names=[n for n, _ in fields])
        out, size = [[] for _ in fields], 0
        return made

    def add(n: int, *row):
        nonlocal size
        for column, value in zip(out, row):
            column.append(value)
        size += n
        return size > BLOCK_BYTES * 4
    return add, record


def _context_rows(length: int):
    """The bytes of the contexts in `places`; `shift` is where the anchor lies in them."""
    def run(batches):
        add, record = _collector([("bucket", pa.binary()), ("context", pa.binary()), ("n", pa.int64()), ("rows", pa.int64()),
                                   ("shift", pa.int64()), ("bytes", pa.binary())])
        for b in batches:
            for text, places in zip(b.column("text").to_pylist(), b.column("places").to_pylist()):
                data = text.encode()
                for p in places:
                    window = data[p["lo"]: p["hi"] + length]
                    if add(len(window), p["gram"].to_bytes(8, "little", signed=True), p["context"], p["n"], p["n"],
                           p["at"] - p["lo"], window):
                        yield record()
        yield record()
    return run


def _piece_rows(length: int, block: int):
    """Contexts cut where their starts, counted from the anchor, begin a new `block`.

    Windows of one block share length + 1 - block bytes, which become the key of a new bucket:
    equal windows lie as far from their anchor, so they have the same block and the same bytes there.
    """
    def run(batches):
        add, record = _collector([("parent", pa.binary()), ("parent_rows", pa.int64()), ("lo", pa.int64()), ("bucket", pa.binary()),
                                   ("context", pa.binary()), ("n", pa.int64()), ("shift", pa.int64()), ("bytes", pa.binary())])
        for b in batches:
            for bucket, context, n, rows, shift, data in zip(*(b.column(k).to_pylist() for k in (
                    "bucket", "context", "n", "rows", "shift", "bytes"))):
                last = len(data) - length
                for q in range(-shift // block, (last - shift) // block + 1):
                    begin = shift + q * block
                    lo, hi = max(begin, 0), min(begin + block - 1, last)
                    piece = data[lo: hi + length]
                    key = _digest(bucket, q.to_bytes(8, "little", signed=True), data[begin + block - 1: begin + length])
                    if add(len(piece), context, rows, lo, key, _digest(piece), n, shift - lo, piece):
                        yield record()
        yield record()
    return run


def _spans(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2].tolist(), edges[1::2].tolist()


def _sorted_buckets(length: int, period: int):
    """Rows (bucket, context, n, rows, bytes), buckets together -> the repeated starts of each context."""
    def solve(block: list[tuple]):
        """Whole buckets: suffixes of different buckets are different, so they sort together."""
        open_ = [r for bucket in block for r in bucket if len(bucket) > 1]
        hits = repeated_starts([r[3] for r in open_], [r[1] for r in open_], length, period) if open_ else []
        rows = [(r[0], r[2], *_spans(h)) for r, h in zip(open_, hits) if h.any()]
        rows += [(r[0], r[2], [0], [len(r[3]) - length + 1]) for bucket in block if len(bucket) == 1 for r in bucket if r[1] > 1]
        columns = list(zip(*rows)) or [()] * 4
        return pa.record_batch([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()),
                                pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.int64()))],
                               names=["context", "rows", "starts", "stops"])

    def run(batches):
        block, bucket, name, size = [], [], None, 0
        for b in batches:
            for key, context, n, rows, data in zip(*(b.column(k).to_pylist() for k in range(5))):
                if key != name:
                    if bucket:
                        block.append(bucket)
                    if size > BLOCK_BYTES:
                        yield solve(block)
                        block, size = [], 0
                    bucket, name = [], key
                if bucket and bucket[-1][0] == context:  # of a repeated row
                    continue
                bucket.append((context, n, rows, data))
                size += len(data)
        if bucket:
            yield solve([*block, bucket])
    return run


def _solved(contexts: DataFrame, length: int, period: int, hot: int, blocks: tuple[int, ...]) -> DataFrame:
    """(bucket, context, n, rows, shift, bytes), staged -> (context, rows, starts, stops) of those with repeated starts.

    A bucket of over `hot` contexts is cut into the buckets of _piece_rows, which are counted anew and
    cut by the next of `blocks`. The last is 1, a single window: what meets there is equal, hence one row.
    """
    crowds = stage(contexts.groupBy("bucket").agg(F.count("*").alias("m")).filter(F.col("m") > hot), "crowds")
    few, up = contexts, None
    if blocks and not crowds.isEmpty():
        marked = attach(contexts, crowds, "bucket", "m", "context")
        few, many = marked.filter("m IS NULL"), marked.filter("m IS NOT NULL")
        pieces = stage(many.mapInArrow(
            _piece_rows(length, blocks[0]), "parent binary, parent_rows bigint, lo bigint, bucket binary, context binary, "
                                            "n bigint, shift bigint, bytes binary"), "pieces")
        cut = stage(pieces.groupBy("bucket", "context").agg(
            F.sum("n").alias("n"), F.count("*").alias("rows"), F.first("shift").alias("shift"), F.first("bytes").alias("bytes")), "contexts")
        below = stage(_solved(cut, length, period, hot, blocks[1:]), "solved")
        found = attach(pieces.select("parent", "parent_rows", "lo", "context"), below, "context", "rows", "lo").filter("rows IS NOT NULL")
        up = found.groupBy(F.col("parent").alias("context"), F.col("parent_rows").alias("rows")).agg(
            F.flatten(F.collect_list(F.transform("starts", lambda x: x + F.col("lo")))).alias("starts"),
            F.flatten(F.collect_list(F.transform("stops", lambda x: x + F.col("lo")))).alias("stops"))
    solved = few.repartition("bucket").sortWithinPartitions("bucket", "context").select(
        "bucket", "context", "n", "rows", "bytes").mapInArrow(
        _sorted_buckets(length, period), "context binary, rows bigint, starts array<bigint>, stops array<bigint>")
    return solved if up is None else solved.unionByName(up)


def open_contexts(docs: DataFrame, found: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Contexts by what can equal them: (those in a bucket of two or more, as (bucket, context, n, rows,
    shift, bytes); (context, rows, starts, stops) of those alone in theirs, which repeat whole)."""
    distinct = stage(found.groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "at", "lo", "hi")).alias("place")), "distinct")
    shared = stage(distinct.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1"), "shared")
    marked = attach(distinct, shared, "gram", "m", "context")
    whole = marked.filter("m IS NULL AND n > 1").select(
        "context", F.col("n").alias("rows"), F.array(F.lit(0).cast("bigint")).alias("starts"),
        F.array(F.col("place.hi") - F.col("place.lo") + 1).alias("stops"))
    places = marked.filter("m IS NOT NULL").groupBy(F.col("place.doc_id").alias("_d"), F.col("place.text_hash").alias("_h")).agg(
        F.collect_list(F.struct("gram", "context", "n", "place.at", "place.lo", "place.hi")).alias("places"))
    contexts = docs.join(places, docs["doc_id"].eqNullSafe(places["_d"]) & (docs["text_hash"] == places["_h"])).select(
        "text", "places").mapInArrow(
        _context_rows(length), "bucket binary, context binary, n bigint, rows bigint, shift bigint, bytes binary")
    return stage(contexts, "contexts"), whole


def repeated_spans(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, gram: int = GRAM,
                   hot: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, text_hash, text) -> (doc_id, text_hash, spans): byte spans (start, stop) that repeated
    strings of `length` bytes cover; they may overlap. Texts without one are not listed.

    1. The least gram of every window (found once or more) is counted over the corpus; a window
       under a gram that occurs once is unique, so only the others go on.
    2. Windows of one least gram are a bucket of suffixes. Equal texts of windows are one row with
       their number, whose bytes are read from one place; a row alone in its bucket repeats whole. A
       bucket of over `hot` rows is cut by shared bytes until it isn't (_solved).
    3. Buckets are sorted a bounded block at a time (repeated_starts).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stage(docs.mapInArrow(
        _anchor_rows(length, gram),
        f"doc_id {kind}, text_hash bigint, at bigint, lo bigint, hi bigint, gram bigint, context binary"), "anchors")
    counts = stage(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "grams")
    found = stage(attach(found, counts, "gram", "n", "lo").filter("n IS NOT NULL").drop("n"), "open")
    contexts, whole = open_contexts(docs, found, length)
    blocks = tuple(b for b in BLOCKS if b <= length)
    solved = stage(_solved(contexts, length, period, hot, blocks).unionByName(whole), "solved")
    named = attach(found.select("doc_id", "text_hash", "lo", "context"), solved, "context", "rows", "lo")
    spans = named.filter("rows IS NOT NULL").select("doc_id", "text_hash", "lo", F.explode(
        F.arrays_zip("starts", "stops")).alias("s")).select("doc_id", "text_hash", F.struct(
            (F.col("lo") + F.col("s.starts")).alias("start"), (F.col("lo") + F.col("s.stops") + length - 1).alias("stop")).alias("span"))
    return spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def merged(spans: list[dict]) -> Iterator[tuple[int, int]]:
    """Sorted spans as maximal runs."""
    start = stop = None
    for s in spans:
        if stop is not None and s["start"] <= stop:
            stop = max(stop, s["stop"])
        else:
            if stop is not None:
                yield start, stop
            start, stop = s["start"], s["stop"]
    if stop is not None:
        yield start, stop


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                            period: int = PERIOD, gram: int = GRAM, hot: int = HOT_BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    A byte goes if a string of `length` bytes that covers it also starts elsewhere, in the same text
    or another; every occurrence goes, overlaps count, and strings are judged on the input. Texts
    are UTF-8 bytes; null is empty; shorter texts stay. Repeated rows are copies of each other:
    both lose what is long enough. Null ids are treated as any other.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    s = stage(repeated_spans(rows, length, period, gram, hot), "spans").select(
        F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "spans")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                data = text.encode()
                kept, at, removed = [], 0, list(merged(spans or []))
                for start, stop in removed:
                    kept.append(data[at:start])
                    at = stop
                kept = b"".join([*kept, data[at:]])
                for column, value in zip(out, (len(data), len(data) - len(kept), len(removed), kept)):
                    column.append(value)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(s, rows["doc_id"].eqNullSafe(s["_d"]) & (rows["text_hash"] == s["_h"]), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
