import regex

import __spark_entry__
import corpus_pipeline
from tidemark.llm import catalog


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in catalog.QUERIES} and "pipeline" in names


def test_stages_decide_as_brute_force_does(spark, small):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in small.collect()]
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    long_ = max(rows, key=lambda x: x[2] == "en" and len(x[1]))[1]
    rows += [(9001, rows[0][1].upper().replace("É", "É"), "fr", "src0", 1), (9002, "1234 !!", "en", "src1", 1), (9003, None, "en", None, 0),
             (9004, long_ + " again", "en", "src2", 1), (9005, f"Well now. {item} And so on.", "en", "src2", 1)]
    docs = spark.createDataFrame(rows, small.schema)
    text = {r[0]: r[1] for r in rows}
    kept = [set(text)]
    for name, work in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(work(spark, docs, "/root/testdata/sf0.001"), "t")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] - kept[1] == {9002, 9003}
    last = {}
    for i in sorted(kept[1]):
        last[text[i].encode().lower()] = i
    assert kept[2] == set(last.values())
    near = [r for r in kept[2] if text[r] == long_]
    assert 9004 not in kept[3] and set(near) <= kept[3] and len(kept[3]) >= len(kept[2]) - 5
    assert 9005 in kept[3] and 9005 not in kept[4]
    items = [" ".join(regex.findall(r"[\p{L}\p{N}]+", r.text.lower())) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    leaked = {i for i in kept[3] if any(x in " ".join(regex.findall(r"[\p{L}\p{N}]+", text[i].lower())) for x in items)}
    assert kept[3] - kept[4] == leaked
    assert kept[5] <= kept[4]
