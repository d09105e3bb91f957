"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, id_and_text, stage

MIN_LENGTH = 16
SPACE = r"[ \t-\r]+"
VALUE = "[A-Za-z0-9+/_-]{%d,}={0,2}"
SHORT_ASSIGNED = 8  # characters of a value that a key word assigns
KEY_WORD = r"(?i)(passw|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth)"
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789+/_-="
DICTIONARY_COUNT = 20  # a dictionary word occurs so often at least
LABELLED_ROWS = 20_000  # labelled findings of each class that the forest is fitted on, at most
TREES, DEPTH, SEED = 30, 6, 5
FEATURES = ["length", "digits", "uppers", "distinct", "changes", "likelihood", "coverage", "path", "mail",
            "assigned", "quoted", "key_before", "key_in_token", "before_length", "after_length"]
CANDIDATE = ("doc_id", "text_hash", "word")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) -> one row a candidate: word number, token, value, and the words around it.

    A candidate is a token with 16 or more letters, digits and + / _ - in a row, or 8 after an
    assignment to a key word.
    """
    words = F.split(F.col("text"), SPACE)
    token = lambda i: F.get("words", i)
    long_, assigned = VALUE % MIN_LENGTH, KEY_WORD + r"[\w-]*[\"']?[=:].{%d,}" % SHORT_ASSIGNED
    picked = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (F.length(token(i)) >= SHORT_ASSIGNED) & (
        ((F.length(token(i)) >= MIN_LENGTH) & token(i).rlike(long_)) | token(i).rlike(assigned)))
    near = lambda k: F.coalesce(F.get("words", F.col("word") + k), F.lit(""))
    rows = docs.select("doc_id", "text_hash", words.alias("words")).select("*", F.explode(picked).alias("word"))
    rows = rows.select(*CANDIDATE, near(0).alias("token"), near(-1).alias("before"), near(-2).alias("before2"),
                       near(1).alias("after"))
    value = F.regexp_extract("token", f"({long_})", 1)
    short = F.regexp_extract("token", KEY_WORD + r"[\w-]*[\"']?[=:][\"']?([^\s\"']*)", 2)
    return rows.withColumn("value", F.when(F.length(short) >= SHORT_ASSIGNED, short).otherwise(value)).filter("value <> ''")


def dictionary(docs: DataFrame, min_count: int = DICTIONARY_COUNT) -> DataFrame:
    """(word, n): words of Latin letters in all texts, lowered, that occur min_count times or more."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).filter("length(word) >= 3")
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def transition_table(words: DataFrame) -> list[float]:
    """Log probability of each character after another, from the dictionary; len(SYMBOLS) squared, no more."""
    k = len(SYMBOLS)
    pairs = words.filter("length(word) >= 2").select("n", "word", F.explode(F.sequence(
        F.lit(1), F.length("word") - 1)).alias("at")).select("n", F.expr(
            f"(locate(substr(word, at, 1), '{SYMBOLS}') - 1) * {k} + locate(substr(word, at + 1, 1), '{SYMBOLS}') - 1").alias("pair"))
    counts = {r["pair"]: float(r["n"]) for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    table = []
    for a in range(k):
        row = [counts.get(a * k + b, 0.0) + 1.0 for b in range(k)]
        table += [math.log(x / sum(row)) for x in row]
    return table


def _likelihood(value: Column, table: list[float]) -> Column:
    """Mean log probability of the value's character transitions."""
    k = len(SYMBOLS)
    alphabet = F.array(*map(F.lit, SYMBOLS))
    codes = F.filter(F.transform(F.split(F.lower(value), ""), lambda c: F.array_position(alphabet, c).cast("int") - 1),
                     lambda c: c >= 0)
    steps = F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))),
                       F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * k + b)
    logs = F.array(*map(F.lit, table))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + F.get(logs, x)) / F.greatest(F.size(steps), F.lit(1))


def featured(found: DataFrame, words: DataFrame, table: list[float]) -> DataFrame:
    """The candidates with their FEATURES."""
    size = F.length("value").cast("double")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / size
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    text_before = F.concat_ws(" ", "before2", "before")
    rows = found.select(
        "*", size.alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"),
        (F.size(F.array_distinct(F.split("value", ""))) / size).alias("distinct"),
        share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]").alias("changes"),
        _likelihood(F.col("value"), table).alias("likelihood"),
        flag(F.col("token").rlike(r"^[a-z]+://|\\|/[^/]+/|\.[a-z]{2,4}$")).alias("path"),
        flag(F.col("token").contains("@")).alias("mail"),
        flag(F.col("token").rlike("[=:]") | F.col("before").rlike("[=:]$")).alias("assigned"),
        flag(F.col("token").rlike("[\"']")).alias("quoted"), flag(text_before.rlike(KEY_WORD)).alias("key_before"),
        flag(F.col("token").rlike(KEY_WORD)).alias("key_in_token"),
        F.length("before").cast("double").alias("before_length"), F.length("after").cast("double").alias("after_length"))
    # Dictionary coverage: the letters of the value that lie in dictionary words.
    parts = found.select(*CANDIDATE, F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("part"))
    known = attach(parts, words.withColumnRenamed("word", "part"), "part", "n", "doc_id").filter("n IS NOT NULL")
    covered = known.groupBy(*CANDIDATE).agg(F.sum(F.length("part")).alias("letters"))
    c = covered.select(*(F.col(k).alias(f"_{k}") for k in CANDIDATE), "letters")
    joined = rows.join(c, F.col("doc_id").eqNullSafe(c["_doc_id"]) & (F.col("text_hash") == c["_text_hash"]) & (
        F.col("word") == c["_word"]), "left")
    return joined.withColumn("coverage", F.coalesce(F.col("letters") / F.col("length"), F.lit(0.0))).drop(
        *(f"_{k}" for k in CANDIDATE), "letters")


def format_labels(found: DataFrame) -> DataFrame:
    """Findings labelled by format: 1 for a provider's key or a mixed value that a key word assigns, else 0."""
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    provider = F.col("value").rlike("^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})$")
    keyed = ((F.col("key_in_token") == 1.0) | (F.col("key_before") == 1.0)) & (F.col("assigned") == 1.0) & mixed
    return found.withColumn("label", F.when(provider | keyed, 1.0).otherwise(0.0))


def fit_forest(labelled: DataFrame, rows: int = LABELLED_ROWS, trees: int = TREES, depth: int = DEPTH,
               seed: int = SEED) -> PipelineModel | None:
    """A random forest on at most `rows` labelled findings of each class, those of least hash. None
    where one class is missing."""
    order = F.xxhash64(F.lit(seed), *CANDIDATE)
    sample = [labelled.filter(F.col("label") == y).withColumn("_o", order).orderBy("_o").limit(rows) for y in (0.0, 1.0)]
    data = stage(sample[0].unionByName(sample[1]).select(*FEATURES, "label"), "labelled")
    if data.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label")
    return PipelineModel([assembler, forest.fit(assembler.transform(data))])


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                 train_on: Column | None = None) -> DataFrame:
    """doc_id, text_hash, word (its number in the text), value, the FEATURES, label and score of every
    candidate in every text; score over 0.5 is a secret.

    The forest learns from `labelled` findings (FEATURES, CANDIDATE columns and label 0/1); where
    none are given, from this corpus's candidates labelled by format_labels, of the documents in
    train_on (a condition on doc_id). Where a class is missing nothing can be learned, and the
    label by format is the score. Null and empty texts have no candidates. Repeated rows give
    their findings as often. Dictionary and transitions are counted over all texts.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    words = stage(dictionary(rows), "dictionary")
    found = stage(candidates(rows), "candidates")
    all_ = stage(format_labels(featured(found, words, transition_table(words))), "findings")
    source = labelled if labelled is not None else (all_.filter(train_on) if train_on is not None else all_)
    model = fit_forest(source)
    if model is None:
        return all_.withColumn("score", F.col("label"))
    scored = model.transform(all_).withColumn("score", F.get(vector_to_array("probability"), 1))
    return scored.drop("features", "rawPrediction", "probability", "prediction")
