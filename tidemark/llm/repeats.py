"""Runs of units (lines, sentences) that occur earlier in the corpus, and texts without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, stage

ROW = ("doc_id", "text_hash")  # rows that share an id, but not a text, are told apart


def later_runs(runs: DataFrame) -> DataFrame:
    """(key, doc_id, text_hash, pos) -> the rows that are not the first of their key, by id, text and
    position. A frequent key is counted before any row moves, and its rows are spread (attach)."""
    spread = "doc_id"
    counts = runs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    hits = stage(attach(runs, stage(counts, "counts"), "key", "n", spread).filter("n IS NOT NULL").drop("n"), "hits")
    place = F.struct(*ROW, "pos")
    firsts = stage(hits.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")), "firsts")
    return attach(hits, firsts, "key", "n", spread).filter(~F.col("first").eqNullSafe(place)).select(*ROW, "pos")


def covered_units(later: DataFrame, run: int) -> DataFrame:
    """(doc_id, text_hash, removed): sorted distinct units that runs of `run` units at pos cover."""
    units = later.select(*ROW, F.explode(F.sequence(F.col("pos"), F.col("pos") + run - 1)).alias("unit"))
    return units.groupBy(*ROW).agg(F.array_sort(F.collect_set("unit")).alias("removed"))


def with_removed(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """rows (with doc_id, text_hash) and their removed units, an empty array for most."""
    r = removed.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "removed")
    # the removed units grow with the corpus: never broadcast them, not even where they happen to be few
    r = r.hint("merge")
    joined = rows.join(r, rows["doc_id"].eqNullSafe(r["_d"]) & (rows["text_hash"] == r["_h"]), "left")
    return joined.withColumn("removed", F.coalesce("removed", F.expr("cast(array() as array<int>)"))).drop("_d", "_h")


def kept_units(units: Column, removed: Column) -> Column:
    """units without the positions in removed (sorted, from 0): the stretches between them."""
    bounds = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(units)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(removed)), lambda i: F.slice(
        units, F.get(bounds, i) + 2, F.get(bounds, i + 1) - F.get(bounds, i) - 1)))
