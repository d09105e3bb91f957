"""Every operator and stage on odd rows and on an empty table."""

import public_tokenizers
import pytest

import corpus_pipeline
from tidemark.llm import (decontam, exact, langid, lines, mixing, secrets, simhash, spans, suffix, tokens)

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, n long")


ITEMS = [(1, None, 1), (2, "", 1), (None, "ä", 1), (4, "quiet lamps near old harbour while children count", None), (4, "1234", 2)]
OPS = {
    "lines": lambda s, d: lines.line_dedup(d),
    "exact": lambda s, d: exact.exact_dedup(d),
    "tokens": lambda s, d: tokens.count_tokens(d, MODEL),
    "suffix": lambda s, d: suffix.remove_repeated_strings(d),
    "mixing": lambda s, d: mixing.mix_sources(d),
    "spans": lambda s, d: spans.span_dedup(d),
    "decontam": lambda s, d: decontam.decontaminate(d, bench(s, ITEMS)),
    "langid": lambda s, d: langid.identify_languages(d),
    "simhash": lambda s, d: simhash.simhash_components(d),
}


@pytest.mark.parametrize("name", OPS)
def test_a_row_for_each_row(spark, odd, none, name):
    out = OPS[name](spark, odd)
    assert len(out.collect()) == odd.count()
    nothing = OPS[name](spark, none)
    assert nothing.count() == 0 and nothing.columns == out.columns


def test_defined_results(spark, odd):
    got = {r.doc_id: r for r in OPS["exact"](spark, odd).collect() if r.doc_id is not None}
    assert (got[1].keep_id, got[1].group_size, got[1].kept) == (2, 4, False) and got[2].kept
    assert (got[3].keep_id, got[3].group_size) == (4, 3) and got[6].keep_id == 7
    assert {c: got[1][c] for c in ("size", "score", "h", "n", "row")} == {"size": "x", "score": None, "h": 5, "n": 6, "row": "z"}
    n = {r.doc_id: (r.n_bytes, r.n_tokens) for r in OPS["tokens"](spark, odd).collect()}
    assert n[3] == n[4] == (0, 0)
    s = {(r.doc_id, r.n_bytes): r for r in OPS["suffix"](spark, odd).collect()}
    assert s[11, 5000].n_removed == 5000 and s[11, 5000].n_spans == 1 and s[3, 0].n_removed == 0
    c = {r.doc_id: r for r in OPS["simhash"](spark, odd).collect()}
    assert c[3].fingerprint == c[5].fingerprint == "0" * 16 and c[5].component_id == 3 and c[None].component_id is None
    lang = {r.doc_id: r for r in OPS["langid"](spark, odd).collect()}
    assert [lang[k].lang_pred for k in (3, 4, 5, 8)] == ["und"] * 4 and lang[1].lang_pred == "en"
    leaks = {r.doc_id: r for r in OPS["decontam"](spark, odd).collect()}
    assert leaks[9].contaminated and leaks[8].item_ids == [4] and not leaks[3].contaminated
    kept = {r.doc_id: r for r in OPS["lines"](spark, odd).collect()}
    assert (kept[10].n_lines, kept[10].n_removed) == (3001, 2999) and kept[3].n_lines == 0


def test_secrets_on_odd_rows(spark, odd, none):
    out = secrets.scan_secrets(odd)
    assert {r.doc_id for r in out.collect()} == {11}  # one long token; nothing to learn from, so by format
    assert out.first().score == 0.0 and secrets.scan_secrets(none).count() == 0


def test_stages(spark, odd, none, tmp_path):
    bench(spark, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = odd, none
    ids = []
    for name, work in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(work(spark, docs, str(tmp_path)), "t")
        left = corpus_pipeline.stage(work(spark, left, str(tmp_path)), "t")
        assert left.count() == 0 and left.columns[: len(odd.columns)] == odd.columns == docs.columns[: len(odd.columns)]
        ids.append(sorted({r.doc_id for r in docs.collect()}, key=str))
    assert ids[0] == [1, 10, 2, 6, 7, 9, None]  # 11 is like no learned profile
    assert ids[1] == [10, 2, 7, 9] and 9 not in ids[3] and 2 in ids[3]
