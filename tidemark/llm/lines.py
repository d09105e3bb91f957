"""Line dedup by winnowing: repeated runs of lines are found from guaranteed fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, stage
from tidemark.llm.repeats import ROW, covered_units, kept_units, later_runs, with_removed

RUN = 3


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_removed: one row a row of docs.

    A run of `run` or more equal consecutive lines that begins earlier elsewhere, by (doc_id, line),
    is deleted; its first occurrence stays. Precisely: each window of `run` lines that is not the
    first of its content loses its lines, also within one document and where windows overlap.
    Shorter texts, null and empty texts (no lines, n_lines 0) stay. Null ids come first in order.
    Repeated rows are one document: each loses the same lines, none because of the other.

    Winnowing: the leftmost least line hash of every window is a fingerprint, so equal runs share
    one at the same place. Fingerprints found once end there. Around the others the runs they
    stand for are compared, and overlapping matches join to longer ones on both sides.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    lines = rows.filter("text <> ''").select(*ROW, F.split("text", "\n").alias("lines")).filter(
        F.size("lines") >= run).withColumn("h", F.transform("lines", lambda x: F.xxhash64(x)))
    windows = F.transform(F.sequence(F.lit(0), F.size("h") - run), lambda j: F.struct(
        j.alias("pos"), (j + F.array_position(F.slice("h", j + 1, run), F.array_min(F.slice("h", j + 1, run))) - 1).alias("at"),
        F.unhex(F.md5(F.array_join(F.slice("lines", j + 1, run), "\n").cast("binary"))).alias("key")))
    picked = stage(lines.select(*ROW, "h", F.explode(windows).alias("w")).select(
        *ROW, "w.pos", "w.at", "w.key", F.element_at("h", (F.col("w.at") + 1).cast("int")).alias("print")), "windows")
    # the same fingerprint of one document counts once, in however many windows it is the least
    prints = picked.select("print", *ROW, "at").distinct().groupBy("print").agg(F.count("*").alias("n")).filter("n > 1")
    joined = picked.join(stage(prints, "prints").select("print"), "print", "left_semi").select("key", *ROW, "pos")
    removed = covered_units(later_runs(joined), run)
    out = with_removed(rows, stage(removed, "removed")).withColumn(
        "lines", F.when(F.col("text") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("text", "\n")))
    return out.select("doc_id", F.array_join(kept_units(F.col("lines"), F.col("removed")), "\n").alias("text"),
                      F.size("lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"))
