"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.common import id_and_text

DIMENSIONS, NGRAM, SEED = 1024, 3, 9
CODE_BITS = 21
GROUP_CHARS = 1 << 19
TABLE_ROWS = 1 << 15
UNKNOWN = "und"


def held_out(id_col: Column) -> Column:
    """True for documents whose crc32(id as text) mod 3 is 1; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class _Letters:
    """Code point -> itself lowered if a letter, else a blank."""

    def __init__(self):
        self.table = np.full(0x110000, 32, np.int64)
        for page in range(0, 0x110000, 0x100):
            for c in range(page, page + 0x100):
                x = chr(c)
                if x.isalpha():
                    low = x.lower()
                    self.table[c] = ord(low) if len(low) == 1 else c


class NgramVectors:
    """The vectors of n-grams met so far: position-permuted random letter vectors, bound by product."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.codes, self.rows = np.zeros(0, np.int64), np.zeros((0, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        """+1/-1 vector of a letter: depends on the seed and the letter only."""
        if code not in self.letters:
            rng = np.random.Generator(np.random.PCG64([self.seed, code]))
            self.letters[code] = (rng.integers(0, 2, self.dimensions) * 2 - 1).astype(np.int8)
        return self.letters[code]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Rows for sorted distinct n-gram codes; the table is emptied when it has grown large."""
        if len(self.codes) > TABLE_ROWS:
            self.codes, self.rows = self.codes[:0], self.rows[:0]
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(new):
            bound = np.ones((len(new), self.dimensions), np.int8)
            for place in range(NGRAM):
                part = new >> CODE_BITS * place & (1 << CODE_BITS) - 1
                known, where = np.unique(part, return_inverse=True)
                bound *= np.stack([np.roll(self.letter(c), place) for c in known.tolist()])[where]
            merged = np.concatenate([self.codes, new])
            order = np.argsort(merged)
            self.codes, self.rows = merged[order], np.concatenate([self.rows, bound])[order]
        return self.rows[np.searchsorted(self.codes, codes)]


class Profiler:
    """Bundles of whole texts: the sum of their n-grams' vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.vectors, self.alphabet = NgramVectors(dimensions, seed), _Letters().table

    def ngrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, n-gram code, count) over all texts; blanks stand around and between words."""
        gap = " " * NGRAM
        points = np.frombuffer(gap.join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
        letters = self.alphabet[points]
        owner = np.repeat(np.arange(len(texts) + 1), [NGRAM, *(len(t) + NGRAM for t in texts)]) - 1
        keep = np.append(True, (letters[1:] != 32) | (letters[:-1] != 32))  # one blank between words
        letters, owner = letters[keep], owner[keep]
        real = np.flatnonzero(letters[1:-1] != 32) + 1  # each n-gram once, by its middle letter
        met = np.flatnonzero(np.bincount(letters))  # the group's alphabet, numbered densely
        number = np.zeros(int(met[-1]) + 1, np.int64)
        number[met] = np.arange(len(met))
        dense, k = number[letters], len(met)
        key = ((owner[real] * k + dense[real - 1]) * k + dense[real]) * k + dense[real + 1]
        key, counts = np.unique(key, return_counts=True)
        code = met[key // k**2 % k] | met[key // k % k] << CODE_BITS | met[key % k] << 2 * CODE_BITS
        return key // k**3, code, counts

    def bundles(self, texts: list[str], label: list | None = None) -> Iterator[tuple[list[int], np.ndarray]]:
        """(text numbers, their bundles) for texts with a letter, a bounded group at a time.

        With labels, the bundles of a group's texts of one label are one sum, under the first one's number.
        """
        for first, group in _groups(texts):
            owner, code, count = self.ngrams(group)
            if not len(owner):
                continue
            if label is not None:
                lead: dict = {}
                owner = np.array([lead.setdefault(label[first + i], i) for i in range(len(group))])[owner]
            known, column = np.unique(code, return_inverse=True)
            who, row = np.unique(owner, return_inverse=True)
            weights = np.bincount(row * len(known) + column, count, len(who) * len(known))
            yield (first + who).tolist(), weights.reshape(len(who), -1).astype(np.float32) @ self.vectors.of(
                known).astype(np.float32)


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of bounded length; a very long one is cut into parts that are summed later."""
    start, group, size = 0, [], 0
    for i, t in enumerate(texts):
        while len(t) > GROUP_CHARS:
            yield i, [t[:GROUP_CHARS]]
            t = t[GROUP_CHARS:]
        if not group:
            start = i
        group.append(t)
        size += len(t)
        if size > GROUP_CHARS:
            yield start, group
            group, size = [], 0
    if group:
        yield start, group


def train_prototypes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """One bundle per language over all labelled documents that are not held out.

    Each task sums its own documents and gives dimensions numbers a language; what reaches the
    driver is one row a language, whatever the size of the corpus.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches):
        profiler, sums = Profiler(dimensions, seed), {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for numbers, rows_ in profiler.bundles(b.column("text").to_pylist(), langs):
                for i, bundle in zip(numbers, rows_):
                    total = sums.setdefault(langs[i], np.zeros(dimensions, np.float64))
                    total += bundle
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])],
                                  names=["lang", "bundle"])

    parts = rows.mapInArrow(run, "lang string, bundle array<double>")
    summed = parts.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(
        F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v"))
    return {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in summed.collect()}


def language_of(text: Column, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = SEED) -> Column:
    """struct<lang_pred, score>: the language whose prototype has the largest cosine with the text's
    bundle, and that cosine (0 to 1; negative ones count as 0). Ties: the first by name.

    `und`, score 0: null or empty text, no letter, or nothing learned. Whole texts are read, very
    long ones in parts.
    """
    names = sorted(prototypes)
    norms = [np.linalg.norm(prototypes[n]) for n in names]
    matrix = np.array([prototypes[n] / (z or 1) for n, z in zip(names, norms)], np.float64).reshape(len(names), dimensions)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        profiler = Profiler(dimensions, seed)
        for part in parts:
            total: dict[int, np.ndarray] = {}
            for numbers, rows in profiler.bundles([t or "" for t in part]):
                for i, bundle in zip(numbers, rows):
                    total[i] = total[i] + bundle if i in total else bundle
            langs, scores = [UNKNOWN] * len(part), [0.0] * len(part)
            for i, bundle in total.items() if names else ():
                cosines = matrix @ bundle.astype(np.float64) / max(float(np.linalg.norm(bundle)), 1e-12)
                best = int(np.argmax(cosines))
                langs[i], scores[i] = names[best], float(min(1.0, max(0.0, cosines[best])))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return F.pandas_udf(run, kind)(text)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row (see language_of), learned from the rows that are
    not held out. Rows with null or repeated ids are predicted like any other."""
    prototypes = train_prototypes(docs, id_col, text_col, lang_col, dimensions, seed)
    out = id_and_text(docs, id_col, text_col).withColumn(
        "l", language_of(F.col("text"), prototypes, dimensions, seed))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "l.lang_pred", "l.score")
