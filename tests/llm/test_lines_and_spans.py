import random
from collections import Counter

from tidemark.llm import spans
from tidemark.llm.lines import line_dedup
from tidemark.llm.repeats import kept_units
from pyspark.sql import functions as F


def brute(rows, run, keep=lambda key: True):
    """rows: (id, units, normal units) in order -> {id: removed positions}."""
    first, gone = {}, {i: set() for i, _, _ in rows}
    for i, _, norm in sorted(rows, key=lambda x: x[0]):
        for p in range(len(norm) - run + 1):
            key = tuple(norm[p:p + run])
            if keep(key) and first.setdefault(key, (i, p)) != (i, p):
                gone[i] |= set(range(p, p + run))
    return gone


def test_lines_equal_brute_force(spark):
    r = random.Random(1)
    passages = [[r.choice("abcd") * r.randint(0, 3) for _ in range(r.randint(2, 9))] for _ in range(8)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(r.randint(1, 4)):
            lines += r.choice(passages) if r.random() < 0.6 else [f"own {r.random()}"]
        rows.append((i, "\n".join(lines)))
    for run in (2, 3, 4):
        gone = brute([(i, 0, t.split("\n") if t else []) for i, t in rows], run)
        want = {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) for i, t in rows}
        got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), run=run).collect()
        assert {x.doc_id: (x.text, x.n_removed) for x in got} == want


def test_spans_equal_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    sentence = lambda: " ".join(word() for _ in range(r.randint(1, 40))) + r.choice([". ", "! ", "\n"])
    passages = ["".join(sentence() for _ in range(r.randint(1, 6))) for _ in range(6)]
    rows = [(i, "".join(r.choice(passages) if r.random() < 0.4 else sentence() for _ in range(r.randint(0, 6)))) for i in range(60)]
    rows += [(60, rows[5][1].upper()), (61, "  \n no stop " + " ".join(word() for _ in range(200))), (62, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    units = {x.doc_id: x.u for x in docs.select("doc_id", spans.sentences(F.coalesce("text", F.lit(""))).alias("u")).collect()}
    assert all("".join(units[i]) == (t or "") and all(len(u.split()) <= 24 for u in units[i]) for i, t in rows)
    norm = {i: [" ".join(u.lower().split()) for u in x] for i, x in units.items()}
    gone = brute([(i, 0, norm[i]) for i, _ in rows], 3, lambda key: len("\n".join(key)) - len("".join(key).replace(" ", "")) + 1 >= 10)
    want = {i: ("".join(u for k, u in enumerate(units[i]) if k not in gone[i]), len(gone[i])) for i, _ in rows}
    got = spans.span_dedup(docs).collect()
    assert {x.doc_id: (x.text, x.n_removed) for x in got} == want
    assert sum(map(len, gone.values())) > 20


def test_a_repeated_passage_of_over_fifty_words_goes(spark):
    one = " ".join(f"w{k}" for k in range(60)) + "."
    two = " ".join(f"v{k}" for k in range(30)) + ". " + " ".join(f"u{k}" for k in range(25)) + "."
    rows = [(k, f"Own start {k} here.\n{p}\nOwn end {k} there.") for k, p in enumerate([one, two, one, two])]
    got = {x.doc_id: x.text for x in spans.span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert one in got[0] and two in got[1] and got[2] == "Own start 2 here.\nOwn end 2 there." and "v3" not in got[3]


def test_kept_units(spark):
    d = spark.sql("select array('a','b','c','d') as u, array(0, 2) as r union all select array('x'), cast(array() as array<int>) "
                  "union all select array('x','y'), array(0, 1)")
    assert Counter(tuple(x.k) for x in d.select(kept_units(F.col("u"), F.col("r")).alias("k")).collect()) == Counter(
        [("b", "d"), ("x",), ()])
