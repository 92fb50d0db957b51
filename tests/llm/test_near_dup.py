import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from invq.llm import chunks, queries
from invq.llm import near_dup as N
from invq.llm.graph import components
from tests.llm import cases


def classes(pairs, length=5, threshold=0.8):
    """Brute force: every pair that shares a shingle, by weighted Jaccard similarity."""
    vectors = []
    for key, text in pairs:
        w = cases.split(text)
        grams = [tuple(w[i : i + length]) for i in range(len(w) - length + 1)] if len(w) >= length else [tuple(w)][: len(w)]
        vectors.append((key, Counter(grams)))
    df = Counter(g for _, v in vectors for g in v)
    n = len(vectors)
    weight = {g: 1 + math.log((1 + n) / (1 + k)) / math.log(1 + n) for g, k in df.items()}
    by_gram = defaultdict(list)
    for i, (_, v) in enumerate(vectors):
        for g in v:
            by_gram[g].append(i)
    near = {(a, b) for members in by_gram.values() for a in members for b in members if a < b}
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in near:
        (_, u), (_, v) = vectors[a], vectors[b]
        both = sum(min(c, v[g]) * weight[g] for g, c in u.items())
        total = sum(c * weight[g] for g, c in u.items()) + sum(c * weight[g] for g, c in v.items()) - both
        if both / total >= threshold:
            up[root(a)] = root(b)
    least = {}
    for i, (key, _) in enumerate(vectors):
        least[root(i)] = min(least.get(root(i), key), key)
    return {key: least[root(i)] for i, (key, _) in enumerate(vectors)}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(chunks, "BUCKET_ENTRIES", 10_000)


def test_query_equals_brute_force(spark, small):
    _, pairs = cases.documents(spark)
    rows = queries.op7_near_dup(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.class_id for r in rows} == classes(pairs)


def test_large_groups_of_copies_and_near_copies(spark, small):
    base = [f"w{i}" for i in range(120)]
    pairs = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 160):  # one word changed each: near the base, and near each other or not quite
        text = list(base)
        text[i % 120] = f"new{i}"
        pairs.append((i, " ".join(text)))
    pairs += [(1000 + i, " ".join(f"x{i}-{j}" for j in range(60))) for i in range(20)]
    rows = N.classes(cases.table(spark, pairs)).collect()
    found = {r.doc_id: r.class_id for r in rows}
    assert found == classes(pairs)
    assert set(found[i] for i in range(160)) == {0}
    kept = N.deduplicated(cases.table(spark, pairs))
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(1000, 1020)]


def test_draws_agree_as_often_as_weighted_jaccard_says():
    rng = np.random.default_rng(1)
    hash_ = rng.integers(0, 1 << 48, 400).astype(np.uint64)
    weight = rng.uniform(0.5, 3.0, 400)
    a, b = np.sort(hash_[:300]), np.sort(hash_[100:])
    of = dict(zip(hash_.tolist(), weight, strict=True))
    wa = np.array([of[x] for x in a.tolist()])
    wb = np.array([of[x] for x in b.tolist()]) * 1.2
    both = sum(min(of[x], 1.2 * of[x]) for x in set(a.tolist()) & set(b.tolist()))
    similarity = both / (wa.sum() + wb.sum() - both)
    draws = 3000
    one = N.sample(a, wa, np.array([0]), draws, 1)
    two = N.sample(b, wb, np.array([0]), draws, 1)
    assert abs((one == two).mean() - similarity) < 4 * math.sqrt(0.25 / draws)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in found} == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_edges(spark):
    rows = N.classes(cases.odd(spark)).collect()
    found = sorted((r.doc_id or 0, r.class_id) for r in rows if r.doc_id is not None)
    # 7 and 8 hold the same two words; 3, 4 and 5 hold none and are alone
    assert found == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (7, 7), (8, 7), (9, 9), (10, 10), (11, 11)]
    assert [r.class_id for r in rows if r.doc_id is None] == [None]
    kept = N.deduplicated(cases.odd(spark))
    assert kept.columns == cases.odd(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 9, 10, 11] and ids.count(None) == 1
    assert N.classes(cases.none(spark)).collect() == []
    assert N.deduplicated(cases.none(spark)).collect() == []
