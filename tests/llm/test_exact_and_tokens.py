import hashlib
import random
from collections import defaultdict

import public_tokenizers
import sentencepiece

from tidemark.llm import tokens
from tidemark.llm.exact import exact_dedup


def test_equal_texts_whatever_the_filter(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["Same ÄÖ text", "sAME ÄÖ TEXT", "same äö text", f"own {r.randint(0, 900)}"])) for i in range(1500)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t.encode().lower()].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for i in g}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (1 << 15, 1 << 20):
        got = exact_dedup(docs, max_bits=bits).collect()
        assert {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got} == want


def test_tokens_equal_the_library(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    pool = list("      ▁▁\n\tabcdeinrst.,()[]=-_/\"'<>#*019") + ["é", "ß", "漢", "😀", "​", "\0", "the ", "ing", "    ", "return ", "==", "　", "и", "İ", "<s>", "</s>", "<0x41>"]
    texts = ["".join(r.choices(pool, k=r.randint(0, 50))) for _ in range(6000)]
    texts += [" " * n for n in range(60)] + ["a" * n + "=" * n + "-" * n for n in range(60)] + ["\n" * 700, "ab" * 900, "x " * 3000]
    want = [len(x) for x in library.encode(texts, num_threads=1)]
    model = open(path, "rb").read()
    assert tokens.TextCounter(model).counts(texts) == want
    monkeypatch.setattr(tokens, "PART_CHARS", 7)  # the cuts of very long texts
    monkeypatch.setattr(tokens, "CACHED_WORDS", 50)
    assert tokens.TextCounter(model).counts(texts) == want
