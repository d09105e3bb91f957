"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, stage


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(arcs: DataFrame, label: str, keep) -> DataFrame:
    """arcs (a, b): every kept neighbour b of a is linked to the least of a and its neighbours."""
    least = stage(arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), label)
    joined = attach(arcs.filter(keep), least, "a", "n", "b")
    return joined


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) bigint, undirected -> (node, component): the smallest node reachable.

    Nodes without an edge are not listed. Each round is a few keyed aggregates and joins over the
    edges; a hub's arcs are spread (see attach), and every round is stored in the shared folder.
    """
    now = stage(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct(), "edges")
    before = _print_of(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, "large", F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(large.filter("a != b").distinct(), "edges")
        small = _star(now, "small", F.lit(True))
        links = small.select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stage(links.select("e.a", "e.b").filter("a != b").distinct(), "edges")
        after = _print_of(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
