"""Token counts of byte-fallback BPE piece models by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text

SPACE = "▁"  # stands for the blank in pieces
CHAR_BITS = 21
CACHED_WORDS = 1_000_000
PART_CHARS = 1 << 21
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceRanks:
    """The merges of a model as arrays: (left symbol, right symbol) -> merged symbol and its rank.

    Symbols are piece ids, and n_pieces + code point for characters that are no piece. A merged
    piece is `lone` if a piece of the same or a better rank starts or ends with it: then only the
    leftmost of several equal pairs may merge at once.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        ids = {sp.id_to_piece(i): i for i in range(n) if i not in special}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids):
            raise ValueError("a piece crosses a word boundary")
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in ids.values()}, reverse=True))}
        rank = {p: order[sp.get_score(i)] for p, i in ids.items()}
        self.n, self.ids = n, ids

        def symbol(part: str) -> int | None:
            return ids.get(part, n + ord(part) if len(part) == 1 else None)

        pairs, lone = {}, set()
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                a, b = symbol(left), symbol(right)
                if a is not None and b is not None:
                    pairs[a << CHAR_BITS | b] = (rank[piece], i)
                lone |= {ids[p] for p in (left, right) if p in ids and rank[p] >= rank[piece]}
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()] + [np.iinfo(np.int32).max], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int32)
        self.lone = np.zeros(n, bool)
        self.lone[list(lone)] = True
        # a symbol left at the end is one token, or as many as it has UTF-8 bytes
        self.char = {c: i for c, i in ids.items() if len(c) == 1}

    def _pair(self, symbols: np.ndarray, seq: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the pair that starts at each position i stands in the tables; their end if nowhere."""
        j = np.minimum(i + 1, len(symbols) - 1)
        key = symbols[i] << CHAR_BITS | symbols[j]
        at = np.searchsorted(self.keys, key)
        at[(i == j) | (seq[i] != seq[j]) | (self.keys[np.minimum(at, len(self.keys) - 1)] != key)] = len(self.keys)
        return at

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word (with its leading SPACE), all words at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        known, where = np.unique(points, return_inverse=True)
        symbols = np.array([self.char.get(chr(c), self.n + c) for c in known.tolist()], np.int64)[where]
        size = 1 + (known > 0x7F).astype(np.int64) + (known > 0x7FF) + (known > 0xFFFF)
        extra = np.where([chr(c) in self.char for c in known.tolist()], 0, size - 1)[where]
        seq = np.repeat(np.arange(len(words)), lengths)
        # A character that is no piece may still merge away; its bytes count only if it stays.
        tokens = np.zeros(len(words), np.int64)

        def settle(done: np.ndarray) -> None:
            np.add.at(tokens, seq[done], 1 + np.where(symbols[done] >= self.n, extra[done], 0))

        at = self._pair(symbols, seq, np.arange(len(symbols)))
        while len(symbols):
            rank = self.rank[at]
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            least = np.minimum.reduceat(rank, starts)
            best = np.repeat(least, np.diff(np.append(starts, len(seq))))
            if least.max() == self.rank[-1]:
                open_ = best != self.rank[-1]
                settle(~open_)
                symbols, extra, seq, at, rank, best = (x[open_] for x in (symbols, extra, seq, at, rank, best))
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == best)
            # Equal pairs in a row overlap: take every second from the left; of a lone piece the first only.
            first = np.append(True, seq[hit[1:]] != seq[hit[:-1]])
            head = first | np.append(True, np.diff(hit) != 1)
            begin = hit[np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))]
            # a pair of the same rank further on may be another piece: it waits with the lone ones
            alone = self.lone[self.merged[at[hit]]]
            alone = np.logical_or.reduceat(alone, np.flatnonzero(first))[np.cumsum(first) - 1]
            hit = hit[np.where(alone, first, (hit - begin) % 2 == 0)]
            symbols[hit] = self.merged[at[hit]]
            extra[hit] = 0
            left = np.ones(len(symbols), bool)
            left[hit + 1] = False
            symbols, extra, seq, at = symbols[left], extra[left], seq[left], at[left]
            hit = hit - np.arange(len(hit))
            for changed in (hit, hit[hit > 0] - 1):
                at[changed] = self._pair(symbols, seq, changed)
        return tokens


def words_of(text: str) -> list[str]:
    """The pre-tokens of one text, each without its first SPACE; no piece crosses their borders."""
    text = text.replace(SPACE, " ")
    words = text.split(" ")
    if "" not in words:
        return words
    return [w[1:] for w in _RUNS.findall(SPACE + text.replace(" ", SPACE))]


def text_parts(text: str):
    """A very long text in parts, cut at single blanks, which start the next part's first word."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = at + PART_CHARS
        while (cut := text.find(" ", cut)) > 0 and text[cut - 1] in (" ", SPACE):
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class TextCounter:
    """Counts whole texts; words already counted are looked up (a bounded table)."""

    def __init__(self, model: bytes):
        self.ranks, self.known = PieceRanks(model), {}

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        for group in _groups(texts):
            split = [words_of(p) for t in group for p in (text_parts(t) if t else [""])]
            parts = [1 if not t else sum(1 for _ in text_parts(t)) for t in group]
            if len(self.known) > CACHED_WORDS:
                self.known.clear()
            new = list(set().union(*split) - self.known.keys())
            if new:
                self.known.update(zip(new, self.ranks.count([SPACE + w for w in new]).tolist()))
            sums = [sum(map(self.known.__getitem__, w)) for w in split]
            at = 0
            for t, k in zip(group, parts):
                out.append(sum(sums[at:at + k]) if t else 0)
                at += k
        return out


def _groups(texts: list[str]):
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size > PART_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    Equal to what the model's library gives for the whole text without begin or end tokens. Null
    text is empty (0 tokens). Rows with equal or null ids are returned as they come. The driver
    reads the model (a fixed vocabulary, half a megabyte) and sends it to the workers, so
    executors need no copy of the file. The model must not normalise and must put a blank before
    each text, as piece_bpe_32k.model does.
    """
    rows = id_and_text(docs, id_col, text_col)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        counter = TextCounter(model.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = counter.counts(texts)
            yield pa.record_batch(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn(
        "over_limit", F.col("n_tokens") > limit)
