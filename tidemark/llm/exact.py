"""Exact duplicates: a two-pass Bloom filter decides which rows have to shuffle at all."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm.common import attach, stage

BITS_PER_ROW = 16
MIN_BITS, MAX_BITS = 1 << 15, 1 << 28
BLOCK_BITS = 1 << 15  # of Spark's bitmap functions


@F.pandas_udf(StringType())
def normal_sha256(texts: pd.Series) -> pd.Series:
    """SHA-256 of the text with A-Z lowered; null counts as empty."""
    return pd.Series([hashlib.sha256((t or "").encode().lower()).hexdigest() for t in texts], dtype="object")


def _slots(sha, bits: int):
    """Two independent slots of the filter, from the hash's first and next 48 bits."""
    return [F.pmod(F.conv(F.substring(sha, at, 12), 16, 10).cast("long"), F.lit(bits)) for at in (1, 13)]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_bits: int = MAX_BITS) -> DataFrame:
    """All rows and columns of docs with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lowering A-Z; null counts as empty. The largest id of a
    group stays. Input columns of those four names are replaced. Repeated ids: rows of the kept id
    all stay. A null id is smaller than any other; a group of null ids only is kept whole
    (keep_id null). An empty table gives an empty result.

    Pass 1 counts slots of a Bloom filter (saturating at two) and keeps the bitmap of slots hit
    twice: at most max_bits / 8 bytes (32 MB), which is what makes it safe to broadcast. Pass 2
    tests each row; one with both slots set may be repeated, and only such rows shuffle. A filter
    too small for the table flags more rows; results stay exact.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    rows = docs.withColumn("text_sha256", normal_sha256(F.col(text_col)))
    n = docs.select(id_col).count()
    bits = min(max_bits, max(MIN_BITS, 1 << max(0, n * BITS_PER_ROW - 1).bit_length()))
    slots = rows.select(F.explode(F.array(*_slots("text_sha256", bits))).alias("slot")).groupBy("slot").agg(
        F.count("*").alias("hits")).filter("hits > 1")
    bitmap = stage(slots.groupBy(F.floor(F.col("slot") / BLOCK_BITS).cast("int").alias("block")).agg(
        F.expr(f"bitmap_construct_agg(slot % {BLOCK_BITS})").alias("bits")), "bloom")

    tested = rows
    for i, slot in enumerate(_slots("text_sha256", bits)):
        block = F.broadcast(bitmap.select(F.col("block").alias(f"_b{i}"), F.col("bits").alias(f"_m{i}")))
        tested = tested.withColumn(f"_s{i}", slot).join(
            block, F.floor(F.col(f"_s{i}") / BLOCK_BITS).cast("int") == F.col(f"_b{i}"), "left")
    bit = "(conv(hex(substring(_m{0}, int(_s{0} % 32768 div 8) + 1, 1)), 16, 10) >> int(_s{0} % 8)) & 1"
    maybe = F.expr(" AND ".join(f"coalesce(({bit.format(i)}) = 1, false)" for i in (0, 1)))
    tested = tested.withColumn("_maybe", maybe)
    columns = rows.columns

    groups = stage(tested.filter("_maybe").groupBy("text_sha256").agg(
        F.max(id_col).alias("keep_id"), F.count("*").alias("group_size")), "groups")
    repeated = attach(tested.filter("_maybe").select(columns), groups, "text_sha256", "group_size", id_col)
    single = tested.filter("NOT _maybe").select(
        *columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return single.unionByName(repeated).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
