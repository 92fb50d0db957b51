import itertools
from collections import Counter

import numpy as np
import pytest

from invq.llm import quality as Q
from invq.llm import queries
from tests.llm import cases


def brute(text):
    words = cases.split(text)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    times, covered = Counter(triples), set()
    for i, t in enumerate(triples):
        if times[t] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if cases.split(line):
            again += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, again, len(covered)


def test_query_statistics_equal_brute_force(spark):
    _, pairs = cases.documents(spark)
    rows = {r.doc_id: r for r in queries.op4_quality(spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in pairs:
        r = rows[doc_id]
        found = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == found
        assert r.base_failed == (found[0] < 50 or 100 * found[4] > 50 * found[0])
        assert not (r.base_failed and r.kept)


def test_labelled_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op4_quality(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    bad = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_edges(spark):
    rows = Q.statistics(cases.odd(spark)).select("row.doc_id", "row.text", "row.chunk", *Q.STATISTICS).collect()
    assert len(rows) == len(cases.ROWS)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.chunk == "c"
    kept = Q.filtered(cases.odd(spark))
    assert kept.columns == cases.odd(spark).columns
    # too few rows for an estimate: only the base rules reject
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 6]
    assert Q.filtered(cases.none(spark)).collect() == []


def test_scatter_of_normal_rows_is_recovered(spark):
    rng = np.random.default_rng(3)
    scale = np.array([1.0, 0.5, 0.4, 0.6, 0.5])
    x = rng.normal(size=(4000, 5)) * scale
    x[:600] += 12  # a cluster of outliers
    rows = [("=en", "=a", False, *map(float, v)) for v in x]
    kinds = ", ".join(f"{c} double" for c in Q.FEATURES)
    vectors = spark.createDataFrame(rows, f"g_lang string, g_source string, base_failed boolean, {kinds}")
    fit = Q.fit(vectors).where("level = 0").first()
    assert np.abs(fit.centre).max() < 0.1
    diagonal = [fit.precision[k] for k, (i, j) in enumerate(Q._PAIRS) if i == j]
    expected = 1 / (scale**2 + np.square(Q.FLOOR))
    assert np.allclose(diagonal, expected, rtol=0.25)
    judged = Q.judged(vectors, Q.fit(vectors))
    assert judged.where("not kept").count() == 600


@pytest.mark.parametrize("seed", range(6))
def test_support_of_least_determinant_equals_trying_all(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(11, 5)) * [1, 0.5, 0.4, 0.6, 0.5]
    x[:3] += rng.normal(size=(3, 5)) + 4
    h = int(np.ceil(Q.SUPPORT * len(x)))
    least = min(Q._moments(x[list(some)])[2] for some in itertools.combinations(range(len(x)), h))
    assert Q.least_determinant(x)[2] == pytest.approx(least, abs=1e-9)


def test_steps_over_all_rows_do_not_raise_the_determinant(spark, monkeypatch):
    """With more steps a group's determinant is the same or less, and small samples end where large ones do."""
    rng = np.random.default_rng(5)
    rows = [("=en", f"={i % 2}", False, *map(float, rng.normal(size=5) + 3 * (i % 7 == 0))) for i in range(3000)]
    kinds = ", ".join(f"{c} double" for c in Q.FEATURES)
    vectors = spark.createDataFrame(rows, f"g_lang string, g_source string, base_failed boolean, {kinds}")

    def determinants():
        return {(r.level, r.g_lang, r.g_source): r.log_det for r in Q.fit(vectors).collect()}

    monkeypatch.setattr(Q, "STEPS", 6)
    many = determinants()
    monkeypatch.setattr(Q, "STEPS", 1)
    one = determinants()
    assert set(one) == set(many) and len(many) == 4
    assert all(many[k] <= one[k] + 1e-9 for k in one)
    monkeypatch.setattr(Q, "STEPS", 3)
    assert all(v == pytest.approx(many[k], abs=0.05) for k, v in determinants().items())


def test_cut():
    assert Q._chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert 7 < Q.CUTOFF < 7.2


def test_consistency_factor():
    assert Q._chi2_cdf(3.357, 4) == pytest.approx(0.5, abs=1e-3)
    assert Q.consistency(5, 0.75) > 1
