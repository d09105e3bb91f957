"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the next one's docs.

Rows travel as one struct beside the operators' own columns, so columns of any name pass unchanged.
SQL can't express the language profiles and SimHash; tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table, stage
from tidemark.llm.decontam import contaminations
from tidemark.llm.exact import exact_dedup
from tidemark.llm.langid import UNKNOWN, language_of, train_prototypes
from tidemark.llm.mixing import mix_sources, mixture
from tidemark.llm.near import near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
MIN_SCORE = 0.05  # cosine with the nearest language below which a text is of none


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no language go: null, empty, without a letter, or unlike every learned profile.

    Profiles are learned from the labelled documents that are not held out; where there are none,
    nothing is rejected but texts without letters."""
    prototypes = train_prototypes(docs)
    found = _packed(docs).withColumn("l", language_of(F.col("row.text"), prototypes))
    if not prototypes:
        return found.filter(F.col("row.text").rlike(r"\p{L}")).select("row.*")
    return found.filter((F.col("l.lang_pred") != UNKNOWN) & (F.col("l.score") >= MIN_SCORE)).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered) the one with the largest doc_id stays; of its repeated rows, one."""
    kept = exact_dedup(_packed(docs), "row.doc_id", "row.text").filter("kept")
    single, several = kept.filter("group_size = 1"), kept.filter("group_size > 1")
    return single.unionByName(several.dropDuplicates(["text_sha256"])).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest
    doc_id stays; rows without an id stay."""
    dropped = near_duplicates(docs).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    dropped = stage(dropped, "near")
    same = (F.col("row.doc_id") == F.col("id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("hash"))
    return _packed(docs).join(dropped, same, "left_anti").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, and those that are a clipped item."""
    hits = contaminations(docs, read_table(spark, sf_dir, "benchmark"), shorter=True)
    hits = stage(hits.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct(), "leaks")
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("hash"))
    return _packed(docs).join(hits, same, "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights: a row each time a document is drawn, with mix_epoch and mix_shard.
    Columns of those two names in the input are replaced."""
    drawn = mixture(mix_sources(_packed(docs), "row.doc_id", "row.text", "row.source"), "row.doc_id")
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("mix_epoch", "mix_shard")]
    return drawn.select(*columns, F.col("epoch").alias("mix_epoch"), F.col("shard").alias("mix_shard"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", keep_identified),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
