"""Helpers the operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: A key with more than one row in HOT_SHARE is hot; so at most HOT_SHARE keys are, whatever the data.
HOT_SHARE = 1000
BLOCK_BYTES = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and nothing else, so no other column of the input can clash; null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """Left-join the columns of groups (one row a key; size = the key's rows) onto rows.

    Hot keys, at most HOT_SHARE by definition, are broadcast, and their rows are dealt by `spread`
    instead of the key, so no task receives a whole hot group. Null keys match nothing.
    `groups` is read three times: stage it.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    others = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) * HOT_SHARE > total)
    cold = groups.filter(F.col(size) * HOT_SHARE <= total)
    hot = F.broadcast(hot.select(F.col(key).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in others)))
    cold = cold.select(F.col(key).alias("_cold"), F.lit(0).alias("_cold_salt"),
                       *(F.col(c).alias(f"_cold_{c}") for c in others))
    kept = [F.col(c) for c in rows.columns]
    marked = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(),
                        1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")).otherwise(0))
    return marked.join(cold, (F.col(key) == F.col("_cold")) & (F.col("_salt") == F.col("_cold_salt")), "left").select(
        *kept, *(F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in others))


def word_blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The text in pieces cut at white space, so that a very long text never becomes one list of words."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + size) if at + size < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end
