import math
import random

import pytest

from invq.llm import line_dedup as D
from invq.llm import queries
from tests.checker import compare, duck
from tests.llm import cases


def brute(pairs, threshold=90):
    """Kept text of each document; pairs in key order, equal rows as one document."""
    lines = []
    for key, text in sorted(set(pairs), key=lambda p: p[0]):
        for i, line in enumerate([] if text is None else text.split("\n")):
            lines.append((key, i, frozenset(cases.split(line))))
    gone = set()
    for a, (key, i, words) in enumerate(lines):
        for _, _, other in lines[:a]:
            if words and 100 * len(words & other) >= threshold * len(words | other):
                gone.add((key, i))
                break
    out = {}
    for key, text in pairs:
        if text is None:
            out[key] = (0, 0, None)
            continue
        parts = text.split("\n")
        kept = [p for i, p in enumerate(parts) if (key, i) not in gone]
        out[key] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return out


def run(df):
    rows = D.deduplicated(df).select("row.doc_id", "n_lines", "n_removed", "kept").collect()
    return {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in rows}


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    problem, n = compare(spark, duck(sf), "op5", queries.op5_line_dedup, queries.OP5_SQL, sf)
    assert problem is None and n == 200


@pytest.mark.parametrize("seed", [1, 2])
def test_many_variants_of_a_line(spark, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(40)]
    pairs = []
    for key in range(80):
        lines = []
        for _ in range(3):
            words = [w for w in base if rng.random() > 0.03] + [f"v{rng.randrange(30)}" for _ in range(rng.randrange(4))]
            rng.shuffle(words)
            lines.append(" ".join(words))
        lines.append(" ".join(f"own{key}-{i}" for i in range(12)))
        pairs.append((key, "\n".join(lines)))
    assert run(cases.table(spark, pairs)) == brute(pairs)


@pytest.mark.parametrize("common", [1, 10**12])
def test_words_that_are_all_rare_or_all_common(spark, monkeypatch, common):
    monkeypatch.setattr(D, "COMMON", common)
    rng = random.Random(common)
    words = [f"w{i}" for i in range(24)]
    pairs = [(key // 2, "\n".join(" ".join(rng.sample(words, rng.randrange(19, 23))) for _ in range(3))) for key in range(40)]
    pairs = [(key, f"{text}\n{key}") for key, text in dict(pairs).items()]
    assert run(cases.table(spark, pairs)) == brute(pairs)


def test_words_are_ranked_as_plain_numbers(spark):
    rows = D._identified(cases.table(spark, [(1, "a b c\td\ne")]), "doc_id", "text")
    table = D._prefixes(rows, D._rarities(rows), 90)
    assert not table.schema["prefix"].dataType.containsNull  # else sorted as objects
    assert sorted(r.n for r in table.collect()) == [1, 4]


def test_rarities_stay_short_in_the_plan(spark):
    """The driver keeps the plan's text: every bucket in it is a small number, whatever the words."""
    pairs = [(i, " ".join([f"w{k}" for k in range(1000 * i, 1000 * i + 1000)] + ["x"] * 50)) for i in range(300)]
    rows = D._identified(cases.table(spark, pairs), "doc_id", "text")
    rarities = D._rarities(rows)
    level = rows.sparkSession.range(1).select(rarities.alias("level")).first().level
    assert len(level) == D.COUNTED and sum(n > 0 for n in level) > D.COUNTED / 2
    assert max(level) == round(16 * math.log2(300 * 50))  # of x; a few words share its bucket
    plan = D._prefixes(rows, rarities, 90)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 6 * D.COUNTED


def test_bitmaps_of_long_sets_differ(spark):
    """Each word turns a bit; where each only sets one, the bitmaps of 400 words are all ones."""
    both, own = [f"w{i}" for i in range(200)], [[f"{c}{i}" for i in range(200)] for c in "ab"]
    rows = D._identified(cases.table(spark, [(i, " ".join(both + own[i])) for i in (0, 1)]), "doc_id", "text")
    a, b = [r.bits for r in D._prefixes(rows, D._rarities(rows), 90).collect()]
    assert 16 <= ((a ^ b) & (2**64 - 1)).bit_count() <= 400


@pytest.mark.parametrize("common, passes", [(1, 1), (10**12, 2)])
def test_texts_are_read_for_common_words_only_if_there_are_any(spark, monkeypatch, common, passes):
    made, written = [], D.written
    monkeypatch.setattr(D, "COMMON", common)
    monkeypatch.setattr(D, "written", lambda df, purpose: made.append(purpose) or written(df, purpose))
    pairs = [(i, " ".join(f"w{k}" for k in range(30) if k != i)) for i in range(4)]
    assert run(cases.table(spark, pairs)) == brute(pairs)
    assert made.count("line-words") == passes


def test_copies_of_a_row_with_similar_lines(spark):
    lines = [" ".join(f"w{k}" for k in range(30) if k != i) for i in range(3)]
    pairs = [(1, lines[0] + "\nx"), (1, lines[0] + "\nx"), (2, lines[1]), (2, lines[1]), (2, lines[2]), (3, "x\n" + lines[2])]
    rows = D.deduplicated(cases.table(spark, pairs)).select("row.doc_id", "row.text", "n_removed").collect()
    removed = sorted((r.doc_id, r.text, r.n_removed) for r in rows)
    assert removed == sorted((k, t, {1: 0, 2: 1, 3: 2}[k]) for k, t in pairs)


def test_all_in_dataframe_operations(spark):
    made = D.deduplicated(cases.table(spark, [(1, "a b\nc"), (2, "a b")]))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_edges(spark):
    odd = cases.odd(spark)
    made = D.deduplicated(odd)
    assert made.select("row.*").columns == odd.columns
    pairs = [(-1 if r[0] is None else r[0], r[1]) for r in cases.ROWS]
    found = {(-1 if k is None else k): v for k, v in run(odd).items()}
    assert found == brute(pairs)
    assert made.count() == len(cases.ROWS)
    assert run(cases.none(spark)) == {}
