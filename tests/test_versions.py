import random

import pytest
from pyspark.sql import functions as F

from invq.operators import snapshots as S
from invq.sources import versions as V
from tests.helpers import rows

SCHEMA = "a int, b string, v string"


def table(spark, records):
    return spark.createDataFrame([(*k, v) for k, v in records.items()], SCHEMA)


def held(spark, path, number=None):
    return {(a, b): v for a, b, v in rows(V.read_snapshot(spark, path, number), "a", "b", "v")}


def test_versions_follow_a_dict(spark, tmp_path):
    rng, path, plain, states = random.Random(2), str(tmp_path / "t"), {}, []
    for i in range(4):
        some = {(rng.randrange(30), rng.choice(["x", None])): f"{i}-{j}" for j in range([25, 3, 0, 12][i])}
        assert V.upsert_snapshot(table(spark, some) if some else spark.createDataFrame([], SCHEMA), path, ["a", "b"], f"s{i}", 8) == i
        plain = plain | some
        states.append(plain)
        assert held(spark, path) == plain
    assert [held(spark, path, i) for i in range(4)] == states


def test_a_snapshot_counts_once(spark, tmp_path):
    path, one = str(tmp_path), {(1, "x"): "1", (None, None): "2"}
    assert V.upsert_snapshot(table(spark, one), path, ["a", "b"], "s0", 4) == 0
    assert V.upsert_snapshot(table(spark, {(1, "x"): "later"}), path, ["a", "b"], "s1") == 1
    assert V.upsert_snapshot(table(spark, one), path, ["a", "b"], "s0") == 0  # repeated after a later one
    assert held(spark, path) == {(1, "x"): "later", (None, None): "2"}
    assert V.read_snapshot(spark, path).count() == 2


def test_only_touched_buckets_are_written(spark, tmp_path):
    path, many = str(tmp_path), {(i, "x"): "0" for i in range(200)}
    V.upsert_snapshot(table(spark, many), path, ["a", "b"], "s0", 16)
    V.upsert_snapshot(table(spark, {(7, "x"): "1"}), path, ["a", "b"], "s1")
    listed = V.versions(spark, path).where("number = 1")
    assert listed.count() == 16
    assert sorted(r["count"] for r in listed.groupBy("folder").count().collect()) == [1, 15]
    assert held(spark, path) == many | {(7, "x"): "1"}


def test_a_killed_write_is_not_seen(spark, tmp_path, monkeypatch):
    path, one, two = str(tmp_path), {(1, "x"): "1"}, {(1, "x"): "2", (2, "y"): "3"}
    V.upsert_snapshot(table(spark, one), path, ["a", "b"], "s0", 4)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(V, "_publish", killed)  # all data files are there, the list is not
        V.upsert_snapshot(table(spark, two), path, ["a", "b"], "s1")
    assert held(spark, path) == one
    (tmp_path / "versions" / "number=1" / "_temporary").mkdir(parents=True)  # killed while it wrote the list
    assert held(spark, path) == one
    assert V.upsert_snapshot(table(spark, two), path, ["a", "b"], "s1") == 1
    assert held(spark, path) == two


def test_stable_fields_are_carried_into_the_next_version(spark, tmp_path):
    schema = "id int, kind string, props map<string,string>"
    old = spark.createDataFrame([(1, "metrics_key", {"name": "a", "key_id": "k"}), (2, "metrics_key", {"name": "b"})], schema)
    new = spark.createDataFrame([(1, "metrics_key", {"name": "a"})], schema)

    def merge(before, after):
        untouched = before.join(after.select("id"), "id", "left_anti")
        return S.stable_carry_forward(before, after).unionByName(untouched)

    V.upsert_snapshot(old, str(tmp_path), ["id"], "s0", 4)
    V.upsert_snapshot(new, str(tmp_path), ["id"], "s1", merge=merge)
    got = {r.id: r.props for r in V.read_snapshot(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and got[1]["name"] == "a" and got[2] == {"name": "b"}


def test_other_columns_are_refused(spark, tmp_path):
    V.upsert_snapshot(table(spark, {(1, "x"): "1"}), str(tmp_path), ["a", "b"], "s0", 2)
    with pytest.raises(ValueError):
        V.upsert_snapshot(spark.range(3).select(F.col("id").alias("a")), str(tmp_path), ["a"], "s1")
    with pytest.raises(ValueError):
        V.read_snapshot(spark, str(tmp_path / "none"))
