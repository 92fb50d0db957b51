import json

import pytest
from pyspark.sql import functions as F

from invq.functions.skew import hot_join, join_where_known
from invq.sources import io, schemas
from tests.helpers import rows, text_of


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [1, 3, 10, 10**6])
def test_hot_join_is_a_join(spark, how, hot_rows):
    many = [(i, "hot" if i % 3 else f"k{i % 7}") for i in range(100)] + [(100, None), (101, "alone")]
    few = [("hot", 1), ("hot", 2), ("k0", 3), ("k3", 4), ("unused", 5)]
    a = spark.createDataFrame(many, "id int, key string")
    b = spark.createDataFrame(few, "key string, v int")
    got = hot_join(a, b, ["key"], how, hot_rows=hot_rows)
    want = a.join(b, ["key"], how)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, *sorted(want.columns)) == rows(want, *sorted(want.columns))


def test_hot_join_refuses_what_it_would_get_wrong(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        hot_join(df, df, ["id"], "full")


def test_hot_rows_are_cut_into_slices(spark):
    a = spark.range(1000).select(F.lit(1).alias("key"), "id")
    b = spark.createDataFrame([(1, "x")], "key int, v string")
    joined = hot_join(a, b, ["key"], hot_rows=100)
    assert joined.count() == 1000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__slot" in plan and "xxhash64" in plan


def _largest_part(df, column):
    sizes = df.select(F.spark_partition_id().alias("p"), column).groupBy("p").count().collect()
    return max(r["count"] for r in sizes)


@pytest.fixture
def as_dealt(spark):
    """No adaptive execution, no broadcast: partitions are as the shuffle deals them."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_null_keys_are_spread(spark, as_dealt):
    many = spark.range(4000).withColumn("key", F.when(F.col("id") % 1000 == 0, F.col("id")))
    few = spark.range(4000).select(F.col("id").alias("key"), (F.col("id") + 1).alias("v"))
    for joined in (hot_join(many, few, ["key"], "left", hot_rows=1000), join_where_known(many, few, "key")):
        assert rows(joined.where("v is not null"), "id", "v") == [(i, i + 1) for i in range(0, 4000, 1000)]
        assert joined.count() == 4000 and _largest_part(joined, "id") < 1000


def test_a_key_that_is_hot_on_the_other_side_is_cut_there(spark, as_dealt):
    many = spark.createDataFrame([(1, "a"), (2, "b")], "key int, name string")
    few = spark.range(4000).select(F.when(F.col("id") < 3900, 1).otherwise(2).alias("key"), "id")
    counts = spark.createDataFrame([(1, 1, 3900), (2, 1, 100)], "key int, n long, m long")
    joined = hot_join(many, few, ["key"], counts=counts, hot_rows=100)
    assert joined.count() == 4000 and _largest_part(joined, "id") < 1500


def test_listings_are_read_with_a_fixed_schema(spark, tmp_path):
    folder = tmp_path / "account=a" / "region=r"
    folder.mkdir(parents=True)
    vpc = {
        "VpcId": "v",
        "CidrBlockAssociationSet": [
            {"CidrBlock": "10.0.0.0/16", "CidrBlockState": {"State": "associated"}},
            {"CidrBlock": "nonsense", "CidrBlockState": {"State": "failed"}},
        ],
        "Tags": [{"Key": "k", "Value": "1"}, {"Key": "k", "Value": "2"}],
        "Unknown": 1,
    }
    (folder / "x.json").write_text(json.dumps(vpc) + "\n" + json.dumps({"VpcId": "w"}) + "\nbroken{\n")
    df = io.read_listing(spark, str(tmp_path), schemas.VPC, "vpc")
    assert rows(df, "vpc.VpcId") == [("v",), ("w",)]
    bad = io.unreadable_lines(spark, str(tmp_path), schemas.VPC)
    assert rows(bad, "account", "region", "line") == [("a", "r", "broken{")]
    assert bad.first()["file"].endswith("x.json")
    assert {r["account"] for r in df.collect()} == {"a"}
    blocks = schemas.blocks_of(df).collect()
    assert [(b["vpc_id"], b["state"], text_of(b["net"])) for b in blocks] == [
        ("v", "associated", "10.0.0.0/16"), ("v", "failed", None),
    ]
    tags = df.where("vpc.VpcId = 'v'").select(
        schemas.tag_map(F.col("vpc.Tags")).alias("t"),
        schemas.is_tagged(F.col("vpc.Tags"), "k", "2").alias("two"),
        schemas.is_tagged(F.col("vpc.Tags"), "k", "3").alias("three"),
    ).first()
    assert (tags["t"], tags["two"], tags["three"]) == ({"k": "1"}, True, False)


def test_pages_state_and_logs(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"value": [{"name": f"n{i}"}, {"name": "z"}], "nextLink": "x"}, indent=1))
    items = io.read_pages(spark, str(tmp_path / "p*.json"), "struct<name:string>")
    assert rows(items, "item.name") == [("n0",), ("n1",), ("z",), ("z",)]
    for page in (2, 10):
        text = json.dumps({"value": [{"name": f"{page}-{i}"} for i in range(2)]})
        (tmp_path / f"listing-{page}.json").write_text(text)
    ordered = io.read_pages(spark, str(tmp_path / "listing-*.json"), "struct<name:string>").orderBy("position")
    assert [r["name"] for r in ordered.select("item.name").collect()] == ["2-0", "2-1", "10-0", "10-1"]
    export = {"deployment": {"resources": [{"type": "t", "urn": "u", "outputs": {"vpcId": "v"}}, {"type": "x"}]}}
    state = spark.createDataFrame([("s", json.dumps(export))], "stack string, export string")
    assert rows(schemas.resources_of(state), "stack", "type", "urn", "vpc_id") == [("s", "t", "u", "v"), ("s", "x", None, None)]
    (tmp_path / "a.log").write_text("one\ntwo\n")
    assert rows(io.read_log(spark, str(tmp_path / "a.log")), "line") == [("one",), ("two",)]


def test_snapshots_are_written_by_partition(spark, tmp_path):
    df = spark.createDataFrame([("a", "r", "t1", 1), ("b", "r", "t1", 2)], "account string, region string, snapshot_ts string, n int")
    io.write_snapshot(df, str(tmp_path / "s"))
    io.write_snapshot(df, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s")).where("account = 'a'")
    assert rows(back, "n") == [(1,), (1,)]
    assert "PartitionFilters: [isnotnull(account" in back._jdf.queryExecution().executedPlan().toString()
    io.write_results(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
