import datetime as dt

import pytest
from pyspark.sql import functions as F

from invq.operators import naming as N
from invq.operators import snapshots as S
from tests.helpers import rows

BAG = "id int, kind string, props map<string,string>"


def diff(spark, kind, old, new):
    a = spark.createDataFrame([] if old is None else [(1, kind, old)], BAG)
    b = spark.createDataFrame([] if new is None else [(1, kind, new)], BAG)
    row = S.state_diff(a, b).first()
    return row["action"], row["replaces"]


ENV = {"env_name": "e", "cloud": "AWS", "region": "r"}


@pytest.mark.parametrize(
    ("kind", "old", "new", "action", "replaces"),
    [
        ("environment", None, ENV, "create", []),
        ("environment", ENV, None, "delete", []),
        ("environment", ENV, ENV, "same", []),
        ("environment", ENV, ENV | {"cloud": "aws"}, "update", []),
        ("environment", ENV, ENV | {"cloud": "gcp", "region": "q"}, "replace", ["cloud", "region"]),
        ("environment", ENV | {"env_name": ""}, ENV, "replace", ["env_name"]),
        ("environment", {"cloud": "x"}, ENV, "replace", ["env_name"]),
        ("environment", ENV, ENV | {"is_public_endpoint_enabled": "true"}, "same", []),
        ("environment", ENV, ENV | {"is_public_endpoint_enabled": "false"}, "replace", ["is_public_endpoint_enabled"]),
        ("service_account", {"client_id": "c", "name": "a"}, {"name": "a"}, "replace", ["client_id"]),
        ("service_account", {"client_id": "c", "client_secret": "s", "name": "a"}, {"name": "b"}, "replace", ["name"]),
        ("api_key", {"value": "v", "org_id": "o"}, {"org_id": "p", "key_name": "k"}, "replace", ["key_name", "org_id"]),
        ("dns_delegation", {"subdomain": "a", "nameservers": "1"}, {"subdomain": "a", "nameservers": "2"}, "update", []),
        ("dns_delegation", {"subdomain": "a"}, {"subdomain": "b"}, "replace", ["subdomain"]),
        ("metrics_key", {"name": "a"}, {"name": "b"}, "same", []),
        ("metrics_access", {"workload_role_arn": "a"}, {"workload_role_arn": "b"}, "update", []),
        ("gateway_key", {"environment": "a"}, {"environment": "b"}, "replace", ["environment"]),
        ("uninstaller", {"image": "a"}, {"image": "b"}, "update", []),
        ("unknown", {"a": "1"}, {"a": "2"}, "same", []),
    ],
)
def test_diff(spark, kind, old, new, action, replaces):
    assert diff(spark, kind, old, new) == (action, replaces)


def test_server_assigned_fields_are_carried(spark):
    old = spark.createDataFrame(
        [
            (1, "environment", ENV | {"org_id": "o"}),
            (3, "environment", ENV),
            (4, "metrics_access", {"workload_role_arn": "a", "amp_region": "r", "their_role": "t"}),
            (5, "metrics_key", {"api_key": "k"}),
        ],
        BAG,
    )
    new = spark.createDataFrame(
        [
            (1, "environment", ENV | {"env_name": "x", "note": "n"}),
            (2, "environment", {"region": "z"}),
            (3, "environment", ENV | {"env_name": "x", "region": "q"}),  # replaced
            (4, "metrics_access", {"workload_role_arn": "b"}),
            (5, "api_key", {"value": "v"}),  # another kind
        ],
        BAG,
    )
    out = {r["id"]: r["props"] for r in S.stable_carry_forward(old, new).collect()}
    assert out == {
        1: ENV | {"org_id": "o", "note": "n"},
        2: {"region": "z"},
        3: ENV | {"env_name": "x", "region": "q"},
        4: {"workload_role_arn": "b", "amp_region": "r"},
        5: {"value": "v"},
    }
    rules = S.kind_rules(access_fields=["their_role"])
    out = {r["id"]: r["props"] for r in S.stable_carry_forward(old, new, rules).collect()}
    assert out[4] == {"workload_role_arn": "b", "amp_region": "r", "their_role": "t"}
    assert S.kind_rules("own_image")["uninstaller"].update == ("kubeconfig", "own_image", "cloud")


def test_later_tags_win(spark):
    df = spark.createDataFrame(
        [({"a": "1", "b": "1"}, {"b": "2", "c": "2"}, None), (None, {"a": "x"}, {"a": "y"})],
        "base map<string,string>, custom map<string,string>, extra map<string,string>",
    )
    got = [r["tags"] for r in S.tag_merge(df, "base", "custom", "extra").collect()]
    assert got == [{"a": "1", "b": "2", "c": "2"}, {"a": "y"}]


def test_the_first_layer_with_a_value_wins(spark):
    data = [(1, "k", "env", ""), (1, "k", "saved", "s"), (1, "k", "default", "d"), (1, "m", "default", None), (1, "n", "other", "x")]
    df = spark.createDataFrame(data, "scope int, key string, layer string, value string")
    out = S.layered_config(df, ("env", "saved", "default"), ["scope"])
    assert rows(out, "key", "value", "layer") == [("k", "s", "saved")]
    config = S.layered_config_json(out, ("m", "k", "c"), ["scope"], {"c": "const"})
    assert config.first()["config"] == '{"k":"s","c":"const"}'


def flatten(spark, text, dialect):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return rows(S.keyvalue_flatten(df, "t", dialect), "key", "value", "ok")


def test_tags_text(spark):
    assert flatten(spark, " a = 1 , b=2=3,a=4,plain,c=,,\td = e ", "tags") == [
        ("a", "4", True), ("b", "2=3", True), ("c", "", True), ("d", "e", True),
    ]
    assert flatten(spark, "", "tags") == [] == flatten(spark, None, "tags")
    many = ",".join(f"k{i % 50}={i}" for i in range(5000))
    assert flatten(spark, many, "tags") == sorted([(f"k{i}", str(4950 + i), True) for i in range(50)], key=repr)


def test_zone_tables_text(spark):
    good = flatten(spark, "us-east-2a=rtb-1, us-east-2b=rtb-2", "zone_tables")
    assert good == [("us-east-2a", "rtb-1", True), ("us-east-2b", "rtb-2", True)]
    for bad in ("us-east-2a=nope", "=rtb-1", "rtb-1"):
        assert flatten(spark, bad, "zone_tables") == [(None, None, False)]


def test_exports_text(spark):
    text = "# x\nexport A=1\nexport B=a=b\nexport A=2\n export C=3\nexport D"
    assert flatten(spark, text, "exports") == [("A", "2", True), ("B", "a=b", True), (None, None, False)]


def test_retention_boundaries_differ_by_cloud(spark):
    day = dt.datetime(2024, 1, 31)
    data = [
        ("activity-scrapes/a", dt.datetime(2024, 1, 1), True, None),
        ("data/activity-scrapes/a", dt.datetime(2024, 1, 1), True, None),
        ("janitor/old", dt.datetime(2024, 1, 1), False, dt.datetime(2024, 1, 30)),
        ("x/old", dt.datetime(2024, 1, 1), False, dt.datetime(2024, 1, 28)),
        ("x/new", dt.datetime(2024, 1, 1), True, None),
    ]
    df = spark.createDataFrame(
        data, "object_key string, modified timestamp_ntz, is_current boolean, noncurrent_since timestamp_ntz"
    )

    def due(rules):
        return rows(S.retention_sweep(df, rules, F.lit(day)), "object_key", "rule")

    assert due(S.aws_rules()) == [("activity-scrapes/a", "delete-activity-scrapes"), ("x/old", "old-versions")]
    assert due(S.gcp_rules()) == [
        ("activity-scrapes/a", "delete-activity-scrapes"), ("janitor/old", "delete-janitor"), ("x/old", "old-versions"),
    ]
    # exactly 30 days is not yet past 30 days; old versions count from creation
    assert due(S.azure_rules()) == [("janitor/old", "old-versions"), ("x/old", "old-versions")]


def names(spark, *specs):
    """Cells of (organisation, environment) with every derived name."""
    df = spark.createDataFrame(list(specs), "org string, env string")
    df = df.withColumn("cell", N.cell_name(F.col("org"), F.col("env")))
    return df.select(
        "cell",
        N.storage_account_name(F.lit("pcstore"), F.col("cell")).alias("storage"),
        N.key_vault_name(F.lit("kv"), F.col("cell")).alias("vault"),
        N.service_account_name(F.lit("prov"), F.col("cell")).alias("account"),
        N.bucket_name(F.lit("data"), F.col("cell")).alias("bucket"),
    ).collect()


def test_names_keep_the_ending(spark):
    (row,) = names(spark, ("Some Organisation, Inc.", "dev-us-ef7a.svc"))
    assert row["cell"] == "someorganisation-byoc-ef7a"
    assert row["storage"] == "pcstore" + "someorgan"[: 24 - 7 - 8] + "byocef7a"
    assert row["vault"] == "kv-" + "someorganis"[: 24 - 2 - 1 - 10] + "-byoc-ef7a"
    assert row["account"] == "prov-" + "someorganisation"[: 30 - 4 - 1 - 10] + "-byoc-ef7a"
    assert row["bucket"] == "pc-data-someorganisation-byoc-ef7a"


def test_an_organisation_with_the_mark_in_it(spark):
    (row,) = names(spark, ("byoc labs", "abcd"))
    assert row["cell"] == "byoclabs-byoc-abcd"
    assert row["storage"] == "pcstorebyoclabsbyocabcd"
    assert row["vault"] == "kv-byoclabs-byoc-abcd"


def test_other_names(spark):
    df = spark.createDataFrame([("a" * 25 + ".x", "my_pool-name-long", "V1.2-Beta_")], "sub string, pool string, version string")
    row = df.select(
        N.balancer_name(F.col("sub"), True).alias("a"),
        N.balancer_name(F.col("sub"), False).alias("b"),
        N.pool_name(F.col("pool")).alias("c"),
        N.job_name("install-", F.col("version")).alias("d"),
    ).first()
    assert tuple(row) == ("a" * 25 + "-priv-a", "a" * 25 + "-alb", "mypoolnamelo", "install-v12-beta")


def test_collisions(spark):
    df = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other"), (4, "much-too-long")], "id int, n string")
    out = N.name_collision_audit(df, {"k": (F.col("n"), 10)}, ["id"])
    assert rows(out, "name", "n_owners", "over_limit") == [("much-too-long", 1, True), ("same", 2, False)]


def test_targets(spark):
    listed = spark.createDataFrame([("c", "pc-a"), ("c", "pc-gone"), ("c", "x"), ("c", ""), ("c", "pc-a")], "cluster string, name string")
    there = spark.createDataFrame([("c", "pc-a"), ("c", "x"), ("c", "metering"), ("d", "tooling")], "cluster string, name string")
    assert rows(S.target_set_resolve(listed, there, ["cluster"]), "name") == [("metering",), ("pc-a",)]


def test_pools(spark):
    df = spark.createDataFrame(
        [
            (1, None),
            (2, []),
            (3, [("p", None, 2, None, None, None, {"nodepool": "mine", "x": "y"}, [("k", "v", None), ("k", "w", "NO_EXECUTE")])]),
        ],
        "id int, node_pools array<struct<name:string,instance_type:string,min_size:int,max_size:int,desired_size:int,"
        "disk_size_gb:int,labels:map<string,string>,taints:array<struct<key:string,value:string,effect:string>>>>",
    )
    out = {r["id"]: r for r in S.nodepool_flatten(df, base_labels={"nodepool": "name", "cell": "id"}).collect()}
    for i in (1, 2):
        assert (out[i]["name"], out[i]["instance_type"], out[i]["desired_size"]) == ("default", "r6in.large", 3)
        assert out[i]["labels"] == {"nodepool": "default", "cell": str(i)} and out[i]["taints"] == []
    assert out[3]["labels"] == {"nodepool": "mine", "x": "y", "cell": "3"}
    assert out[3]["taints"] == ["k=v:NO_SCHEDULE", "k=w:NO_EXECUTE"] and out[3]["min_size"] == 2


def test_rules_of_a_table_are_those_of_the_list(spark):
    """The literal rules as a table, over keys that several rules name, and over equal objects."""
    from datetime import datetime

    days = [datetime(2024, 1, d) for d in (1, 10, 20, 28)]
    keys = ["janitor/a", "activity-scrapes/x/y", "janitor", "other/janitor/a", "", "lag-reporter/"]
    data = [(1, k, m, c, None if c else m) for k in keys for m in days for c in (True, False)] * 2
    objects = spark.createDataFrame(data, "account int, object_key string, modified timestamp, is_current boolean, noncurrent_since timestamp")
    as_of = F.lit(datetime(2024, 2, 3))
    for listed in (S.aws_rules(), S.gcp_rules(), S.azure_rules()):
        rules = [(1, r.name, r.prefix, r.days, r.clock, r.inclusive, r.applies_to) for r in listed]
        rules = spark.createDataFrame(
            rules, "account int, rule string, prefix string, days int, clock string, inclusive boolean, applies_to string"
        )
        want = rows(S.retention_sweep(objects, listed, as_of), "object_key", "modified", "is_current", "rule", "due")
        for sent in (100, 0):
            out = S.retention_sweep_by_rules(objects, rules, as_of, rules_sent=sent)
            assert rows(out, "object_key", "modified", "is_current", "rule", "due") == want
    assert want


def test_prefixes_of_a_key(spark):
    df = spark.createDataFrame([("a/bc/d",), ("",), ("/x",), ("ab",)], "k string")
    got = [r.p for r in df.select(S.prefix_ladder(F.col("k"), "/", [1, 3]).alias("p")).collect()]
    assert got == [["a/bc/", "a/b", "a/", "a", ""], [""], ["/", ""], ["a", ""]]


def test_many_rules_plan_without_a_nested_loop(spark):
    rules = spark.range(3000).selectExpr(
        "cast(id % 7 as int) as account", "concat('r', id) as rule", "concat('p', id, '/') as prefix", "cast(id as int) as days",
        "'modified' as clock", "true as inclusive", "'any' as applies_to",
    )
    objects = spark.range(500).selectExpr(
        "cast(id % 7 as int) as account", "concat('p', id, '/x') as object_key", "timestamp'2020-01-01' as modified",
        "true as is_current", "cast(null as timestamp) as noncurrent_since",
    )
    out = S.retention_sweep_by_rules(objects, rules, F.lit("2024-01-01").cast("timestamp"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.count() == sum(1 for i in range(500) if i % 7 == i % 7 and i <= 1461)


def test_only_rules_that_can_be_due_first_meet_objects(spark):
    data = [(1, f"r{i:03}", "a/", 5 + i % 7, "modified", True, "any") for i in range(200)]
    rules = spark.createDataFrame(data, "account int, rule string, prefix string, days int, clock string, inclusive boolean, applies_to string")
    left = S._earliest_rules(rules, ["account"], ["modified"]).collect()
    assert [(r["rule"], r["days"]) for r in left] == [("r000", 5)]
    asked = spark.createDataFrame([(1, "a/"), *[(1, f"x{i}") for i in range(500)]], "account int, prefix string")
    kept = [r["prefix"] for r in S._named_by_rules(asked, rules, ["account", "prefix"]).collect()]
    assert "a/" in kept and len(kept) < 5


def test_owners_are_hashed_not_sorted(spark):
    df = spark.createDataFrame([(None, "x"), (3, "x"), (1, "x")], "id int, n string")
    out = N.name_collision_audit(df, {"k": (F.col("n"), 10)}, ["id"])
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    (row,) = out.collect()
    assert (row["first_owner"]["id"], row["last_owner"]["id"], row["n_owners"]) == (None, 3, 3)
