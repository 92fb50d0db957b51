import hashlib

import pytest

from invq.llm import chunks, queries
from invq.llm import substring as S
from tests.llm import cases


def brute(pairs, length):
    words = [(key, cases.split(text)) for key, text in pairs]
    first = {}
    for key, w in words:
        for i in range(len(w) - length + 1):
            t = tuple(w[i : i + length])
            first[t] = min(first.get(t, key), key)
    out = []
    for key, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < key:
                gone[i : i + length] = [True] * length
        out.append((key, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 60_000)
    monkeypatch.setattr(chunks, "BUCKET_ENTRIES", 5_000)


def test_query_equals_brute_force_over_many_chunks(spark, small):
    _, pairs = cases.documents(spark)
    rows = queries.op6_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows)
    wanted = [(k, n, g, hashlib.sha256(t.encode()).hexdigest()) for k, n, g, t in brute(pairs, 13)]
    assert found == wanted and sum(r[2] for r in wanted) > 0


@pytest.mark.parametrize("length", [5, 7, 30, 50])
def test_other_lengths(spark, small, length):
    df, pairs = cases.documents(spark, 60)
    rows = S.remove_repeats(df, length).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == brute(pairs, length)


def test_levels_double():
    assert S.levels(13) == [7, 13] and S.levels(5) == [5]
    for length in range(1, 200):
        found = S.levels(length)
        assert found[-1] == length and all(b <= 2 * a and a < b for a, b in zip(found, found[1:], strict=False))


def test_hot_passage_of_many_documents(spark, small):
    passage = " ".join(f"p{i}" for i in range(20))
    pairs = [(i, f"own{i} a{i} b{i} {passage} c{i} d{i}") for i in range(300)]
    rows = S.remove_repeats(cases.table(spark, pairs)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == brute(pairs, 13)


def test_edges(spark):
    rows = S.remove_repeats(cases.odd(spark)).collect()
    pairs = [(-1 if r[0] is None else r[0], r[1]) for r in cases.ROWS]
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows)
    assert found == brute(pairs, 13)
    assert S.remove_repeats(cases.none(spark)).collect() == []
