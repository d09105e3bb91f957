"""Mixing sources to target weights: exact block quotas, split over shards, blocks drawn without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)  # of the sources by code point, repeating
SHARE, MAX_EPOCHS = 1.5, 2.0
BLOCKS, SHARD_LEVELS, SEED = 1 << 14, 4, "mix"
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a staged table after counting it; a larger one is left to the planner."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _fraction(digest: Column) -> Column:
    """The first 32 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, size) -> one row a source: number, source, source_size, docs, target.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all words. No
    target exceeds max_epochs times its source: sources are capped in order of size per weight, and
    the rest is shared by weight, which is where repeated resharing settles.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    numbered = per.withColumn("number", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    by_need = W.orderBy(F.col("source_size") / F.col("weight"), "number")
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    level = numbered.select(
        "*", F.sum("source_size").over(W.partitionBy()).alias("_all"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("_capped"),
        F.sum("weight").over(by_need.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("_rest"),
    ).withColumn("_level", (F.lit(share) * F.col("_all") - F.lit(max_epochs) * F.col("_capped")) / F.col("_rest"))
    fits = F.lit(max_epochs) * F.col("source_size") >= F.col("_level") * F.col("weight")
    settled = level.withColumn("_settled", F.min(F.when(fits, F.struct("_capped", "number", "_level"))).over(W.partitionBy()))
    return settled.select("number", "source", "source_size", "docs", F.coalesce(F.least(
        F.lit(max_epochs) * F.col("source_size"), F.col("_settled._level") * F.col("weight")),
        F.lit(max_epochs) * F.col("source_size")).alias("target"))


def split_quotas(draws: DataFrame, levels: int = SHARD_LEVELS, seed: str = SEED) -> DataFrame:
    """(number, quota): block draws of each source -> (shard, number, quota) for 2 ** levels shards.

    Every node of the tree deals its draws, all alike but for their source, at random into two
    halves of equal size, so the sources' counts on one side are multivariate hypergeometric. The
    sums over shards are the given quotas exactly.
    """
    units = draws.select("number", F.explode(F.expr("sequence(1L, quota)")).alias("unit"), F.lit(0).alias("shard"))
    for level in range(levels):
        node = W.partitionBy("shard")
        order = node.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.lit(level), "number", "unit")), "number", "unit")
        units = units.select("number", "unit", (F.col("shard") * 2 + (
            F.row_number().over(order) * 2 > F.count("*").over(node)).cast("int")).alias("shard"))
    return units.groupBy("shard", "number").agg(F.count("*").alias("quota"))


def plan_draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               blocks: int = BLOCKS, levels: int = SHARD_LEVELS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(targets, draws): targets as source_targets with n_blocks; draws one row a block drawn:
    number, block, epoch, shard, and limit, the words left for a block that is drawn in part (else null)."""
    sizes = stage(_sized(docs, id_col, text_col, source_col, seed).select(
        F.col(source_col).alias("source"), F.col("_size").alias("size"), F.col("_u").alias("u")), "sizes")
    targets = source_targets(sizes)
    block_words = F.greatest(F.lit(1.0), F.sum("source_size").over(W.partitionBy()) / blocks)
    targets = stage(targets.withColumn("n_blocks", F.greatest(
        F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")), "targets")
    held = sizes.join(_small(targets), sizes["source"].eqNullSafe(targets["source"])).groupBy(
        "number", ((F.col("u") * F.col("n_blocks")) / (1 << 32)).cast("long").alias("block")).agg(
        F.sum("size").alias("words"))
    # Whole epochs take every block; the rest takes blocks in a random order, the last one in part.
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    order = W.partitionBy("number").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.lit("block"), "number", "block")), "block")
    laid = held.join(targets, "number").withColumn("whole", epochs).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn(
        "before", F.sum("words").over(order) - F.col("words"))
    part = F.when(F.col("before") + F.col("words") > F.col("rest"), F.col("rest") - F.col("before"))
    taken = F.concat(
        F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0), F.col("whole") - 1), lambda e: F.struct(
            e.alias("epoch"), F.lit(None).cast("double").alias("limit")))).otherwise(F.array()),
        F.when(F.col("before") < F.col("rest"), F.array(F.struct(
            F.col("whole").alias("epoch"), part.alias("limit")))).otherwise(F.array()))
    tokens = stage(laid.select("number", "block", F.inline(taken)), "tokens")
    # Each shard takes its quota of a source's draws, in a random order of their own.
    quotas = split_quotas(tokens.groupBy("number").agg(F.count("*").alias("quota")), levels, seed)
    upto = F.sum("quota").over(W.partitionBy("number").orderBy("shard"))
    ranges = stage(quotas.withColumn("upto", upto), "quotas")
    ranked = tokens.withColumn("rank", F.row_number().over(W.partitionBy("number").orderBy(
        F.md5(F.concat_ws("|", F.lit(seed), F.lit("draw"), "number", "block", "epoch")), "block", "epoch")))
    draws = ranked.join(ranges.withColumnRenamed("number", "_number"), (F.col("number") == F.col("_number")) & (
        F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("quota"))).select(
        "number", "block", "epoch", "limit", "shard")
    return targets, stage(draws, "draws")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")))
    return docs.withColumn("_size", F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")).withColumn(
        "_key", digest).withColumn("_u", _fraction(F.col("_key")))


def drawn(docs: DataFrame, plan: tuple[DataFrame, DataFrame], id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", seed: str = SEED) -> DataFrame:
    """All rows of docs with size, source_size, target and draws: array of (epoch, shard), one for
    each time the mix takes the row. Input columns of those names are replaced."""
    targets, draws = plan
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "draws")]
    named = targets.select(*(F.col(c).alias(f"_t_{c}") for c in ("number", "source", "source_size", "target", "n_blocks")))
    rows = _sized(docs.select(kept), id_col, text_col, source_col, seed).join(
        _small(named), F.col(source_col).eqNullSafe(F.col("_t_source")), "left").withColumn(
        "_block", ((F.col("_u") * F.col("_t_n_blocks")) / (1 << 32)).cast("long"))
    lists = draws.groupBy(F.col("number").alias("_n"), F.col("block").alias("_b")).agg(
        F.sort_array(F.collect_list(F.when(F.col("limit").isNull(), F.struct("epoch", "shard")))).alias("_full"),
        F.max(F.when(F.col("limit").isNotNull(), F.struct("epoch", "shard", "limit"))).alias("_part"))
    lists = stage(lists, "draw-lists")
    rows = rows.join(_small(lists), (F.col("_t_number") == F.col("_n")) & (F.col("_block") == F.col("_b")), "left")
    # In the one block a source takes in part, the documents whose middle word lies within the limit.
    partial = _part_of_block(rows.filter("_part IS NOT NULL"), kept, id_col)
    whole = rows.filter("_part IS NULL").withColumn("draws", F.coalesce("_full", F.expr("array()")))
    out = [*kept, F.col("_size").alias("size"), F.col("_t_source_size").alias("source_size"),
           F.col("_t_target").alias("target"), "draws"]
    return whole.select(out).unionByName(partial.select(out))


def _part_of_block(rows: DataFrame, kept: list[str], id_col: str) -> DataFrame:
    order = W.partitionBy("_n", "_b").orderBy("_key", id_col, "_size").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = F.sum("_size").over(order) - F.col("_size") / 2
    return rows.withColumn("draws", F.when(reached <= F.col("_part.limit"), F.concat("_full", F.array(F.struct(
        F.col("_part.epoch").alias("epoch"), F.col("_part.shard").alias("shard"))))).otherwise(F.col("_full")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                seed: str = SEED, blocks: int = BLOCKS, levels: int = SHARD_LEVELS) -> DataFrame:
    """All rows of docs with size (words), source_size, target, taken (words the mix takes, repeats
    counted) and draws (epoch and shard of each time).

    Null text has size 0; null sources are one source, the last; null ids share one block position.
    Repeated rows fall in the same block and count one by one. A source without words, and an
    empty table, take nothing. Reruns agree: all order comes from hashes of the seed, id and block.
    The plan holds at most 3 * (blocks + sources) draws, whatever the number of rows.
    """
    plan = plan_draws(docs.drop("_size", "_key", "_u"), id_col, text_col, source_col, blocks, levels, seed)
    rows = drawn(docs, plan, id_col, text_col, source_col, seed)
    return rows.withColumn("taken", F.col("size") * F.size("draws"))


def mixture(mixed: DataFrame, id_col: str = "doc_id", seed: str = SEED) -> DataFrame:
    """The mix itself: a row for each draw, dealt to its shard and shuffled there."""
    rows = mixed.select("*", F.inline("draws")).drop("draws", "taken")
    return rows.repartition("shard", F.pmod(F.xxhash64(id_col), F.lit(64))).sortWithinPartitions(
        "shard", F.md5(F.concat_ws("|", F.lit(seed), F.lit("local"), F.col(id_col).cast("string"), "epoch")))
