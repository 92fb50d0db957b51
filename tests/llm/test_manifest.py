import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from invq.llm import checks, queries
from invq.llm import manifest as M
from tests.checker import compare, duck
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grown(nodes):
    """All levels of a tree, the nodes first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def proof(levels, at):
    """(place, run) of each level."""
    out = []
    for nodes in levels[:-1]:
        first = at // 16 * 16
        out.append((at - first, nodes[first : first + 16]))
        at //= 16
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted result rows of the contract."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], leaf_of(*row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[source] = grown([leaf for _, leaf, _ in groups[source]])
    upper = grown([trees[s][-1][0] for s in order])
    root, out = upper[-1][0] if order else None, []
    for i, source in enumerate(order):
        for at, (key, leaf, row) in enumerate(groups[source]):
            steps = proof(trees[source], at) + proof(upper, i)
            others = [x for place, run in steps for x in run[:place] + run[place + 1 :]]
            claimed = leaf
            if key is not None and zlib.crc32(str(key).encode()) % 5 == 0 and row[4] is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                claimed = leaf_of(*row[:4], lower)
            for place, run in steps:
                claimed = h(*run[:place], claimed, *run[place + 1 :])
            out.append((key, leaf, trees[source][-1][0], root, h(*others), claimed, claimed == root))
    return sorted(out, key=repr)


def op12(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, queries.op12_manifest(spark, str(tmp_path)).collect()), key=repr)


def five(df):
    return [tuple(r) for r in df.select(*queries.MANIFEST_FIELDS).collect()]


def test_query_equals_its_sql(spark):
    problem, n = compare(spark, duck(SF), "op12_manifest", queries.op12_manifest, checks.OP12_MANIFEST, SF)
    assert problem is None and n > 0


def test_query_equals_brute_force(spark):
    rows = queries.op12_manifest(spark, SF).collect()
    assert sorted(map(tuple, rows), key=repr) == brute(five(spark.read.parquet(f"{SF}/documents.parquet")))
    assert any(r.verified for r in rows) and not all(r.verified for r in rows)


@pytest.mark.parametrize("sizes", [[1], [16, 17], [1, 255, 256, 257], [4096, 4097, 3], [9000] + [1] * 300])
def test_sizes_about_the_edges_of_runs(spark, tmp_path, sizes):
    rng, rows, key = random.Random(7), [], 0
    for source, n in enumerate(sizes):
        for _ in range(n):
            key += rng.choice([1, 1, 1, 40, 7000])
            rows.append((key, f"s{source}", "en", 1, f"T{key}"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert op12(spark, df, tmp_path) == brute(rows)


def test_repeated_and_null_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "HOT_LEAVES", 100)
    rng = random.Random(3)
    rows = [(None if i % 3 else 5, rng.choice(["a", None]), None, None, f"X {rng.randrange(900)}") for i in range(6000)]
    rows += [(7, "a", "en", 1, "Same")] * 5000
    rows += [(-(2**63), "é", "en", 1, ""), (2**63 - 1, "é", "en", 1, None), (-1, "z", "en", 0, "A"), (0, "z", "en", 0, "b")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert op12(spark, df, tmp_path) == brute(rows)


def test_edges(spark, tmp_path):
    odd = cases.odd(spark)
    assert op12(spark, odd, tmp_path) == brute(five(odd))
    assert op12(spark, cases.none(spark), f"{tmp_path}/none") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, M._KEYS - 1), max_size=300), st.booleans())
def test_ranks_of_a_bitmap(offsets, wide):
    if wide:
        offsets = [*offsets, *range(0, M._KEYS, 9)]
    counts = np.bincount(offsets, minlength=M._KEYS).astype(np.int64)
    bitmap = M.Bitmap(M.pack(counts))
    assert bitmap.listed == (len(set(offsets)) <= M._LIST)
    asked = np.array(sorted(set(offsets)), np.int32)
    rank, tied = bitmap.rank(asked)
    assert rank.tolist() == (np.cumsum(counts) - counts)[asked].tolist()
    assert tied.tolist() == (counts[asked] > 1).tolist()
    merged = counts.copy()
    bitmap.add_to(merged)
    assert (merged == 2 * counts).all()


def test_a_wrong_proof_leads_elsewhere():
    slots = b"".join(sha256(bytes([i])).digest() for i in range(40))
    top = M.levels(slots, 40)[-1]
    proofs = list(M.proofs_in(slots, 40, b"", b""))
    for i, (steps, siblings) in enumerate(proofs):
        assert M.fold(slots[32 * i : 32 * i + 32], steps, siblings) == top
        assert M.fold(slots[:32], steps, siblings) != top or i == 0
    assert M.fold(slots[:32], *proofs[1]) != top
