import re
from collections import Counter

import pytest

from invq.llm import decontaminate as D
from invq.llm import queries
from tests.llm import cases


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(pairs, items, threshold=0.8):
    sets = [(i, shingles(t)) for i, t in items]
    out = Counter()
    for key, text in pairs:
        have = shingles(text)
        for i, s in sets:
            if s and len(s & have) >= threshold * len(s) - 1e-9:
                out[key, i, len(s & have), len(s)] += 1
    return out


def run(docs, items):
    return Counter((r.doc_id, r.item_id, r.n_shared, r.n_windows) for r in D.found(docs, items).collect())


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    found = Counter((r.doc_id, r.item_id, r.n_shared, r.n_windows) for r in queries.op3_decontaminate(spark, sf).collect())
    assert found == brute([tuple(r) for r in docs], [tuple(r) for r in items]) and found


@pytest.fixture
def items(spark):
    words = cases.PROSE.split()
    rows = [
        (1, " ".join(words[3:25])),
        (2, " ".join(words[10:40]).upper() + "!"),
        (3, "too short here"),
        (4, None),
        (None, " ".join(words[20:30])),
        (5, " ".join(words[3:25])),
        (6, " ".join(words[:30] + ["other"] * 40)),
    ]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_long_documents_partial_items_and_blocks(spark, items, monkeypatch):
    rows, df = items
    words = cases.PROSE.split()
    changed = list(words)
    changed[12] = "altered"
    pairs = [
        (1, cases.LONG + " " + cases.PROSE + " " + cases.LONG),
        (2, " ".join(changed)),
        (3, " ".join(words[:20])),
        (4, cases.PROSE.upper().replace(" ", ", ")),
    ]
    wanted = brute(pairs, rows)
    assert run(cases.table(spark, pairs), df) == wanted and len(wanted) > 4
    monkeypatch.setattr(D, "BLOCK", 25)
    assert run(cases.table(spark, pairs), df) == wanted
    clean = D.cleaned(cases.table(spark, pairs), df)
    assert {r.doc_id for r in clean.collect()} == {k for k, _ in pairs} - {k for k, *_ in wanted}


def test_sketches_are_long_enough():
    assert D.sketch_size(1) == 1 and D.sketch_size(30) == 7
    for n in (5, 30, 200, 5000):
        k, chance, apart = D.sketch_size(n), 1.0, n - int(-(-0.8 * n // 1))
        for i in range(k):
            chance *= max(apart - i, 0) / (n - i)
        assert chance <= 1e-9


def test_edges(spark, items):
    rows, df = items
    docs = cases.odd(spark)
    assert run(docs, df) == brute([(r[0], r[1]) for r in cases.ROWS], rows)
    clean = D.cleaned(docs, df)
    assert clean.columns == docs.columns
    hit = {k for k, *_ in brute([(r[0], r[1]) for r in cases.ROWS], rows)}
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(r[0] or 0 for r in cases.ROWS if r[0] not in hit)
    assert D.found(cases.none(spark), df).collect() == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert D.found(docs, nothing).collect() == []
    assert D.cleaned(docs, nothing).count() == len(cases.ROWS)


def test_items_of_few_words_are_found_whole(spark):
    rows = [(1, "red fox"), (2, "Lonely"), (3, "a b c d"), (4, "..."), (5, "fox red")]
    pairs = [(1, "the Red, fox ran"), (2, "lonely hearts"), (3, "x a b c d y"), (4, "a b c"), (5, "red")]
    df = spark.createDataFrame(rows, "item_id long, text string")
    assert run(cases.table(spark, pairs), df) == Counter([(1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 1, 1)])
    assert sorted(r.doc_id for r in D.cleaned(cases.table(spark, pairs), df).collect()) == [4, 5]


def test_punctuation_of_any_script_makes_no_difference(spark):
    plain = "he said the old bridge fell into the river last night"
    typeset = "\u201che said\u201d \u2014 the\u00a0old bridge\u2026 fell\u2013into the \u00abriver\u00bb last\u2003night\u3002"
    items = spark.createDataFrame([(1, plain)], "item_id long, text string")
    assert run(cases.table(spark, [(7, typeset)]), items) == Counter([(7, 1, 7, 7)])


def test_equal_items_reach_the_driver_once(spark):
    items = spark.createDataFrame([(i, "one two three four five six") for i in range(50)], "item_id long, text string")
    ((sent, last),) = D.blocks(D.item_windows(items, "item_id", "text", 5), 0.8)
    assert sum(len(b.items) for b in sent.value.parts.values()) == 1 and last
    assert len(run(cases.table(spark, [(1, "one two three four five six")]), items)) == 50


def test_blocks_come_one_after_the_other(spark, monkeypatch):
    """Many small blocks: the rows are the same, and no plan holds more than one pass."""
    docs, pairs = cases.documents(spark, 60)
    items = spark.createDataFrame([(i, " ".join(t.split()[:40])) for i, t in pairs if t][:20], "item_id long, text string")
    whole, kept = run(docs, items), sorted(r.doc_id for r in D.cleaned(docs, items).collect())
    monkeypatch.setattr(D, "BLOCK", 100)
    assert run(docs, items) == whole and whole
    made = D.cleaned(docs, items)
    assert sorted(r.doc_id for r in made.collect()) == kept
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
