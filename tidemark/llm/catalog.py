"""The registered queries opN_<name> over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table
from tidemark.llm.decontam import decontaminate
from tidemark.llm.exact import exact_dedup
from tidemark.llm.langid import held_out, identify_languages
from tidemark.llm.lines import RUN, line_dedup
from tidemark.llm.mixing import mix_sources
from tidemark.llm.pages import extract_text
from tidemark.llm.repair import damaged, repair_conversations
from tidemark.llm.secrets import scan_secrets
from tidemark.llm.simhash import simhash_components
from tidemark.llm.spans import MAX_WORDS, MIN_WORDS, PIECE, SENTENCE, span_dedup
from tidemark.llm.suffix import remove_repeated_strings
from tidemark.llm.tokens import count_tokens
from tidemark.llm.whitening import whiten

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: A window of units, its later occurrences, and the texts without the units those cover.
REPEATS_SQL = """,
runs AS (SELECT doc_id, i AS pos, {key} AS key FROM (SELECT doc_id, u, unnest(range(len(u) - {run} + 1)) AS i FROM d)
         WHERE {keep}),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS k
          FROM runs) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range({run})) AS unit FROM later),
units AS (SELECT doc_id, unnest(u) AS x, unnest(range(len(u))) AS unit FROM {whole}),
kept AS (SELECT doc_id, string_agg(x, {glue} ORDER BY unit) AS text FROM units ANTI JOIN gone USING (doc_id, unit)
         GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(u) AS BIGINT) AS {count}, coalesce(n.n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""
OP1_SQL = """
WITH d AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS u
           FROM documents)""" + REPEATS_SQL.format(
    key=f"array_to_string(u[i + 1:i + {RUN}], chr(10))", run=RUN, keep="true", whole="d", glue="chr(10)", count="n_lines")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_strings(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(read_table(spark, sf_dir, "documents"), train_on=~held_out(F.col("doc_id")))
    return out.filter("score > 0.5").select("doc_id", "word", "value", "score")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR))) AS k FROM documents),
u AS (SELECT *, CAST('0x' || substr(k, 1, 8) AS BIGINT) AS u FROM s),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
num AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM per),
wt AS (SELECT *, CASE number % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM num),
lev AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (
          ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (
          ORDER BY source_size / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l,
          sum(source_size) OVER () AS everything FROM wt),
cut AS (SELECT *, (SELECT arg_min(l, (source_size / weight, number)) FROM lev WHERE 2.0::DOUBLE * source_size >= l * weight) AS lam FROM lev),
t AS (SELECT *, least(2.0::DOUBLE * source_size, coalesce(lam * weight, 2.0::DOUBLE * source_size)) AS target,
        greatest(1, CAST(ceil(source_size / greatest(1.0::DOUBLE, everything / 16384.0::DOUBLE)) AS BIGINT)) AS n_blocks FROM cut),
d AS (SELECT u.*, t.number, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
        CAST(floor(u.u * t.n_blocks / 4294967296.0::DOUBLE) AS BIGINT) AS block
      FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
held AS (SELECT number, block, any_value(target - whole * source_size) AS rest, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY 1, 2),
laid AS (SELECT *, sum(words) OVER (PARTITION BY number ORDER BY md5(concat_ws('|', 'mix', 'block', number, block)), block) - words
         AS before FROM held),
r AS (SELECT d.*, l.before, l.rest, l.words, sum(d.size) OVER (PARTITION BY d.number, d.block ORDER BY d.k, d.doc_id, d.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2.0::DOUBLE AS reached
      FROM d JOIN laid l USING (number, block))
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN before >= rest THEN 0
         WHEN before + words <= rest THEN 1 WHEN reached <= rest - before THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = span_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = f"""
WITH d AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(coalesce(text, ''), '{SENTENCE}'),
                  lambda s: regexp_extract_all(s, '{PIECE.format(MAX_WORDS)}'))) AS u FROM documents),
norm AS (SELECT doc_id, list_transform(u, lambda s: trim(regexp_replace(lower(s), '[ \\t-\\r]+', ' ', 'g'))) AS u FROM d)
""" + REPEATS_SQL.format(
    key=f"array_to_string(u[i + 1:i + 3], chr(10))", run=3, whole="d", glue="''", count="n_sentences",
    keep="len(array_to_string(u[i + 1:i + 3], chr(10))) - len(translate(array_to_string(u[i + 1:i + 3], chr(10)), "
         f"chr(10) || ' ', '')) + 1 >= {MIN_WORDS}").replace("AS i FROM d)", "AS i FROM norm)")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(read_table(spark, sf_dir, "conversations")))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_mix_sources": op6_mix_sources,
    "op7_span_dedup": op7_span_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_html_extraction": op13_html_extraction,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op6_mix_sources": OP6_SQL,
    "op7_span_dedup": OP7_SQL,
}
