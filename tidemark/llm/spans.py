"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, stage
from tidemark.llm.repeats import ROW, covered_units, kept_units, later_runs, with_removed

RUN, MIN_WORDS, MAX_WORDS = 3, 10, 24
SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t-\r]*|[^.!?\n]+"
PIECE = r"[ \t-\r]*(?:[^ \t-\r]+[ \t-\r]*){{1,{0}}}|[ \t-\r]+"


def sentences(text: Column, max_words: int = MAX_WORDS) -> Column:
    """The text as an array of sentences, with what follows them; their concatenation is the text.

    A sentence ends after . ! ? or a line end; one of more than max_words is cut after every
    max_words from its start, so a long passage without stops is several units as well.
    """
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.regexp_extract_all(
        s, F.lit(PIECE.format(max_words)), F.lit(0))))


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
               min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (what is left), n_sentences, n_removed: one row a row of docs.

    Every run of `run` consecutive sentences with min_words or more is hashed after lowering and
    with white space as single blanks; all but the first of equal runs, by (doc_id, sentence), lose
    their sentences, within one document too. Any repeated passage of over 2 * max_words words that
    begins with a sentence has such runs. Null and empty texts have no sentences and stay. Null ids
    come first in order. Repeated rows are one document: each loses the same sentences.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    norm = F.transform(sentences(F.col("text")), lambda s: F.trim(F.regexp_replace(F.lower(s), r"[ \t-\r]+", " ")))
    unit = rows.filter("text <> ''").select(*ROW, norm.alias("s")).filter(F.size("s") >= run)
    spans = F.filter(F.transform(F.sequence(F.lit(0), F.size("s") - run), lambda j: F.struct(
        j.alias("pos"), F.array_join(F.slice("s", j + 1, run), "\n").alias("span"))),
        lambda x: F.length(x["span"]) - F.length(F.translate(x["span"], "\n ", "")) + 1 >= min_words)
    runs = unit.select(*ROW, F.explode(spans).alias("x")).select(
        F.unhex(F.md5(F.col("x.span").cast("binary"))).alias("key"), *ROW, "x.pos")
    removed = covered_units(later_runs(stage(runs, "spans")), run)
    out = with_removed(rows, stage(removed, "removed")).withColumn("s", sentences(F.col("text")))
    return out.select("doc_id", F.array_join(kept_units(F.col("s"), F.col("removed")), "").alias("text"),
                      F.size("s").cast("long").alias("n_sentences"), F.size("removed").cast("long").alias("n_removed"))
