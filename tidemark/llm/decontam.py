"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, stage

WORDS, SIMILARITY, RADIUS = 5, 0.8, 18
WORD = r"[\p{L}\p{N}]+"
LANES, LANE_BITS = 2, 32  # counters of 32 bits in a sum of 64: no array of shingles is longer
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Letters and digits, lowered: case and punctuation don't hide a passage."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _shingle(hashes: Column, at: Column, words: int) -> Column:
    return F.xxhash64(*(F.get(hashes, at + k) for k in range(words)))


def _small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """Broadcast a staged table whose bytes, summed over its rows, are within the bound; a larger one is
    left to the planner, which joins it by shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def _with_fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with an array `s` of shingle hashes -> keys, s (as a multiset), fp.

    A bit is set if over half of the hashes have it. Two 32-bit counters lie in each of 32 sums.
    """
    lane = sum(1 << LANE_BITS * k for k in range(LANES))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(lane))).alias(f"_s{k}") for k in range(LANE_BITS)]
    counted = rows.select(*keys, F.explode("s").alias("h")).groupBy(*keys).agg(
        F.collect_list("h").alias("s"), F.count("*").alias("_n"), *sums)
    fp = F.lit(0).cast("long")
    for k in range(LANE_BITS):
        for part in range(LANES):
            bit = k + LANE_BITS * part
            value = (1 << bit) - ((1 << 64) if bit == 63 else 0)
            count = F.shiftrightunsigned(f"_s{k}", LANE_BITS * part).bitwiseAND(F.lit((1 << LANE_BITS) - 1))
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("_n"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, "s", fp.alias("fp"))


def _bands(fp: Column, radius: int) -> Column:
    """radius + 1 disjoint blocks of the bits: within the radius, one block at least is equal."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*(F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(fp, a).bitwiseAND(
        F.lit((1 << (b - a)) - 1)).alias("bits")) for k, (a, b) in enumerate(zip(edges, edges[1:]))))


def _first_band(apart: Column, radius: int) -> Column:
    """The first block in which two fingerprints, given what sets them apart, agree: a pair counts once."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    masks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, k) for k, m in enumerate(masks)))


def _overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets: the values in both, and what is repeated in both."""
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731, evaluates x once
    repeats = lambda x: bound(F.array_sort(x), lambda y: F.filter(y, lambda v, i: (i > 0) & (v == F.get(y, i - 1))))
    again = bound(F.struct(repeats(a).alias("a"), repeats(b).alias("b")), lambda r: F.aggregate(
        F.array_distinct(r["b"]), F.lit(0), lambda n, x: n + F.least(
            F.size(F.filter(r["a"], lambda y: y == x)), F.size(F.filter(r["b"], lambda y: y == x)))))
    return F.size(F.array_intersect(a, b)) + again


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, item_hash, n, w, m, s), distinct: hash of the shingles, words, shingle length (5, or all words of a
    shorter item), number of shingles and their hashes."""
    h = F.transform(words_of(F.coalesce(F.col(text_col), F.lit(""))), lambda x: F.xxhash64(x))
    items = benchmark.select(F.col(id_col).alias("item_id"), h.alias("h")).filter("size(h) > 0").distinct().withColumn(
        "n", F.size("h"))
    w = F.least(F.lit(WORDS), F.col("n"))
    shingles = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("w")), lambda k: F.when(
        F.col("n") >= WORDS, _shingle(F.col("h"), k, WORDS)).otherwise(F.xxhash64(F.col("h"))))
    return items.withColumn("w", w).withColumn("s", shingles).select(
        "item_id", F.xxhash64("s").alias("item_hash"), "n", "w", (F.col("n") - F.col("w") + 1).alias("m"), "s")


def _overlap_needed(m: Column, similarity: float) -> Column:
    """Shingles that two windows of m must share for a weighted Jaccard similarity of at least this."""
    return F.ceil(F.lit(2 * similarity / (1 + similarity)) * m - 1e-9)


def _shingles_of(text: Column, length: int) -> Column:
    """Hashes of all runs of `length` words of a text; empty where it has fewer."""
    words = F.transform(words_of(text), lambda x: F.xxhash64(x))
    run = (lambda w, k: _shingle(w, k, WORDS)) if length == WORDS else (lambda w, k: F.xxhash64(F.slice(w, k + 1, length)))
    # The outer transform binds the words once, so that no plan computes them for each shingle.
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) >= length, F.transform(
        F.sequence(F.lit(0), F.size(w) - length), lambda k: run(w, k))))
    return F.coalesce(F.get(made, F.lit(0)), F.expr("array()").cast("array<bigint>"))


def _rare_shingles(items: DataFrame, similarity: float, shorter: bool) -> DataFrame:
    """(h, item_hash, n, m, early): the shingles of an item of which every similar window holds one at least.

    A window may miss m - needed of an item's shingles, so any m - needed + 1 of them will do: those that
    fewest items have, so that a phrase common to many items brings them no candidates. With `shorter`,
    a whole document shorter than the item may miss m - least, so somewhat more count there.
    """
    needed = _overlap_needed(F.col("m"), similarity)
    least = F.ceil(F.lit(similarity) * F.col("m") - 1e-9) if shorter else needed
    each = items.select("item_hash", "n", "m", F.posexplode("s").alias("k", "h"))
    shared = each.groupBy("h").agg(F.countDistinct("item_hash").alias("shared"))
    order = W.partitionBy("item_hash").orderBy("shared", "h", "k")
    ranked = each.join(shared, "h").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("m") - least + 1)
    return ranked.groupBy("h", "item_hash", "n", "m").agg((F.min("rank") <= F.col("m") - needed + 1).alias("early"))


def _windows(docs: DataFrame, items: DataFrame, length: int, similarity: float, shorter: bool) -> DataFrame:
    """(doc_id, text_hash, item_hash, n, at, s): windows with as many shingles as an item, around the places
    where a text holds one of the item's rare shingles. With `shorter`, a document of fewer words
    than the item is one window, if it has similarity * m shingles.

    The texts are read twice: for the places, of which only (id, position, hash) go on, and for the shingles
    of those few texts that have a place.
    """
    rare = stage(_rare_shingles(items.filter(F.col("w") == length), similarity, shorter), "item-shingles")
    # Outer, because an inner generator lets the optimizer infer a filter that computes the shingles once more.
    places = docs.select("doc_id", "text_hash", _shingles_of(F.col("text"), length).alias("all")).select(
        "doc_id", "text_hash", F.size("all").alias("n_all"), F.posexplode_outer("all").alias("i", "h"))
    met = places.join(_small(rare, F.lit(40)), "h").filter(  # 40: bytes of a row
        (F.col("early") & (F.col("n_all") >= F.col("m"))) | (F.lit(shorter) & (F.col("n_all") < F.col("m")) & (
            F.col("n_all") >= similarity * F.col("m") - 1e-9)))
    met = stage(met.select("doc_id", "text_hash", "n_all", "i", "item_hash", "n", "m").distinct(), "places")
    hit = met.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.count("*").alias("_n"))
    texts = docs.join(hit, docs["doc_id"].eqNullSafe(F.col("_d")) & (docs["text_hash"] == F.col("_h"))).select(
        F.col("_d"), F.col("_h"), _shingles_of(F.col("text"), length).alias("all"))
    texts = texts.groupBy("_d", "_h").agg(F.first("all").alias("all"))
    # A window belongs to the first place in it, so none comes twice; runs of starts go on as one row.
    order = W.partitionBy("doc_id", "text_hash", "item_hash").orderBy("i")
    long_ = met.filter(F.col("n_all") >= F.col("m")).withColumn("before", F.coalesce(F.lag("i").over(order), F.lit(-1)))
    starts = long_.select("doc_id", "text_hash", "item_hash", "n", F.col("m").alias("len"),
                          F.greatest(F.lit(0), F.col("i") - F.col("m") + 1, F.col("before") + 1).alias("a"),
                          F.least("i", F.col("n_all") - F.col("m")).alias("b")).filter("a <= b")
    whole = met.filter(F.col("n_all") < F.col("m")).select(
        "doc_id", "text_hash", "item_hash", "n", F.col("n_all").alias("len"), F.lit(0).alias("a"), F.lit(0).alias("b")).distinct()
    cut = starts.unionByName(whole).join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")))
    around = cut.select("doc_id", "text_hash", "item_hash", "n", "len", "a", "b",
                        F.slice("all", F.col("a") + 1, F.col("b") - F.col("a") + F.col("len")).alias("around"))
    return around.select("*", F.explode_outer(F.sequence("a", "b")).alias("at")).select(
        "doc_id", "text_hash", "item_hash", "n", "at", F.slice("around", F.col("at") - F.col("a") + 1, F.col("len")).alias("s"))


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY,
                   radius: int = RADIUS, shorter: bool = False) -> DataFrame:
    """(doc_id, text_hash, item_id, at, n, similarity): windows as long as a benchmark item, of n words, whose
    five-word shingles, counted with repeats, are at least `similarity` alike (weighted Jaccard). With
    `shorter`, a document of fewer words than the item is one window too: a clipped item is a leak.

    An item of fewer than five words is one shingle. Null and empty texts and items match nothing.
    Null ids match as any other; items of one content are compared once. Windows are formed only around an
    item's rare shingles (see _rare_shingles), which loses none that is similar enough. Candidates are the
    pairs of an item and a window made for it whose SimHash fingerprints lie within the radius, found by
    radius + 1 blocks of bits under the item: blocks of three or four bits alone would let nearly all
    windows meet all items.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    named = stage(benchmark_items(benchmark, item_id_col, item_text_col), "items")
    items = stage(named.drop("item_id").distinct(), "contents")
    prints = _with_fingerprint(items, ["item_hash"]).select(F.col("item_hash").alias("item"), F.col("fp").alias("item_fp"))
    lengths = [r["w"] for r in items.select("w").distinct().orderBy("w").collect()]  # at most five
    found = None
    for length in lengths or [WORDS]:
        w = _windows(rows, items, length, similarity, shorter)
        found = w if found is None else found.unionByName(w)
    keys = ["doc_id", "text_hash", "item_hash", "n", "at"]
    windows = stage(_with_fingerprint(found, keys), "windows")
    index = stage(prints.select("*", F.inline(_bands(F.col("item_fp"), radius))), "item-index")
    probes = windows.select("*", F.inline(_bands(F.col("fp"), radius)))
    index = index.withColumnsRenamed({"band": "item_band", "bits": "item_bits"})
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = probes.join(_small(index, F.lit(48)), (F.col("item_hash") == F.col("item")) & (F.col("band") == F.col("item_band")) & (
        F.col("bits") == F.col("item_bits")) & (F.bit_count(apart) <= radius) & (F.col("band") == _first_band(apart, radius)))
    # stored, so that the costly comparison runs on the few pairs that are left
    near = stage(near.select(*keys, "s"), "near")
    contents = items.select(F.col("item_hash").alias("item"), F.col("s").alias("item_s"))
    near = near.join(_small(contents, F.size("item_s") * 8 + 32), F.col("item_hash") == F.col("item"))
    compared = near.withColumn("shared", _overlap(F.col("s"), F.col("item_s"))).withColumn(
        "similarity", F.col("shared") / (F.size("s") + F.size("item_s") - F.col("shared"))).filter(F.col("similarity") >= similarity)
    ids = named.select("item_id", F.col("item_hash").alias("item"), F.col("n").alias("item_n"))
    return compared.drop("item").join(ids, (F.col("item_hash") == F.col("item")) & (F.col("n") == F.col("item_n"))).select(
        "doc_id", "text_hash", "item_id", "at", "n", "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY,
                  radius: int = RADIUS) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (sorted), max_similarity (0 if none): a row a row of docs.
    A document shorter than an item is compared with it as a whole. Items without an id are not listed
    in item_ids; n_items counts them as one."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"))
    hits = contaminations(docs, benchmark, id_col, text_col, item_id_col, item_text_col, similarity, radius, shorter=True)
    per = stage(hits.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("max_similarity"),
        F.max(F.col("item_id").isNull().cast("int")).alias("unnamed")), "leaks")
    out = rows.join(per, rows["doc_id"].eqNullSafe(per["_d"]) & (rows["text_hash"] == per["_h"]), "left")
    return out.select("doc_id", F.col("_h").isNotNull().alias("contaminated"),
                      F.when(F.col("_h").isNotNull(), F.size("item_ids") + F.col("unnamed")).otherwise(0).cast("long").alias("n_items"),
                      F.coalesce("item_ids", F.expr("array()")).alias("item_ids"),
                      F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"))
