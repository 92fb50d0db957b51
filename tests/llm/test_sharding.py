import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from invq.llm import queries
from invq.llm import sharding as S
from tests.llm import cases


def lawful(rows, pairs, n_shards):
    size = Counter(r.shard for r in rows)
    if rows:
        counts = [size[s] for s in range(n_shards)]
        assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(size[s])) for s, v in slots.items())
    found = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    body = [(k, (t or "").encode()) for k, t in pairs]
    assert found == Counter((k, len(b) + 16, zlib.crc32(b)) for k, b in body)


def test_query_keeps_its_law(spark):
    _, pairs = cases.documents(spark)
    lawful(queries.op10_sharding(spark, "/root/testdata/sf0.001").collect(), pairs, 40)


def test_linked_documents_come_together(spark):
    pairs = [(i, f"text {i // 4}" if i < 2000 else f"single {i}") for i in range(6000)]
    rows = S.sharded(cases.table(spark, pairs), 10).collect()
    lawful(rows, pairs, 10)
    of = {r.doc_id: r.shard for r in rows}
    cut = sum(len({of[i] for i in range(4 * g, 4 * g + 4)}) > 1 for g in range(500))
    assert cut < 50  # nearly all 500 before


def test_a_third_of_all_documents_alike(spark):
    pairs = [(i, "the same" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    rows = S.sharded(cases.table(spark, pairs), 10).collect()
    lawful(rows, pairs, 10)
    inside = Counter(r.shard for r in rows if r.doc_id % 3 == 0)
    assert max(inside.values()) <= 300


def shards_of_sets(spark, pairs, n_shards):
    rows = S.sharded(cases.table(spark, pairs), n_shards).collect()
    lawful(rows, pairs, n_shards)
    text, of = dict(pairs), defaultdict(set)
    for r in rows:
        of[text[r.doc_id]].add(r.shard)
    return of


def test_sets_of_a_small_table_stay_whole(spark):
    pairs = [(i, f"set {i // 4}" if i < 40 else f"single {i}") for i in range(200)]
    of = shards_of_sets(spark, pairs, 40)
    assert all(len(of[f"set {g}"]) == 1 for g in range(10))


def test_sets_from_a_hundredth_of_a_shard_to_a_shard_stay_whole(spark):
    copies = [4, 4, 10, 20, 40, 49, 50, 51, 60, 100, 200, 300, 390, 400]
    pairs = [(g * 1000 + i, f"set {g}") for g, n in enumerate(copies) for i in range(n)]
    pairs += [(100_000 + i, f"single {i}") for i in range(4000 - len(pairs))]
    of = shards_of_sets(spark, pairs, 10)
    assert all(len(of[f"set {g}"]) == 1 for g in range(len(copies)))


def test_a_set_larger_than_a_shard_fills_neighbours(spark):
    pairs = [(i, "the same" if i < 950 else f"set {i // 50}") for i in range(4000)]
    of = shards_of_sets(spark, pairs, 10)
    assert len(of["the same"]) == 3 and max(of["the same"]) - min(of["the same"]) == 2
    assert sum(len(s) > 1 for t, s in of.items() if t != "the same") <= 9


def test_quotas_hold_capacity():
    rng = np.random.default_rng(2)
    wishes = rng.integers(0, 50, (8, 8)).astype(float)
    np.fill_diagonal(wishes, 0)
    load = np.full(8, 400.0)
    moved = wishes * S._quotas(wishes, load, 420.0)
    assert (load + moved.sum(0) - moved.sum(1)).max() <= 421
    assert (moved <= wishes + 1e-9).all() and moved.sum() > 0


@pytest.mark.parametrize("n_shards", [1, 3, 40])
def test_edges(spark, n_shards):
    rows = S.sharded(cases.odd(spark), n_shards).collect()
    lawful(rows, [(r[0], r[1]) for r in cases.ROWS], n_shards)
    assert S.sharded(cases.none(spark), n_shards).collect() == []
