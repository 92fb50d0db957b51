import pytest
from pyspark.sql import functions as F

from invq.operators import audit as A
from invq.operators import capacity as K
from tests.helpers import rows


def headroom(spark, applied, default, fallback, used, needed=1, strict=False):
    limits = spark.createDataFrame(
        [("a", "r", applied, default, fallback, needed)],
        "account string, resource string, applied double, provider_default double, fallback int, needed int",
    )
    usage = spark.createDataFrame([("a", "r")] * used + [("b", "r")], "account string, resource string")
    row = K.quota_headroom(usage, limits, ["account"], strict_zero=strict).first()
    return row["quota"], row["available"], row["passed"]


def test_a_quota_of_zero_reads_as_unknown(spark):
    assert headroom(spark, 0.0, 7.0, 5, used=2) == (5, 3, True)
    assert headroom(spark, 0.0, 7.0, 5, used=2, strict=True) == (0, -2, False)
    assert headroom(spark, None, 7.9, 5, used=0) == (7, 7, True)
    assert headroom(spark, None, None, 5, used=5) == (5, 0, False)
    assert headroom(spark, 5.0, None, 5, used=3, needed=3) == (5, 2, False)


def test_a_region_without_a_core_count_passes(spark):
    usages = spark.createDataFrame(
        [("a", "cores", 3, 10, 1), ("a", "cores", 0, 99, 2), ("b", "cores", 0, 8, 1), ("c", "disks", 0, 1, 1)],
        "region string, name string, current_value int, quota int, position int",
    )
    regions = spark.createDataFrame([("a",), ("b",), ("c",)], "region string")
    assert rows(K.core_headroom(usages, regions, ["region"]), "region", "available", "passed") == [
        ("a", 7, False), ("b", 8, True), ("c", None, True),
    ]


def test_zones_without_gateways_count(spark):
    gateways = spark.createDataFrame(
        [("s1", "available"), ("s1", "pending"), ("s1", "deleted"), (None, "available"), ("gone", "available")],
        "subnet_id string, state string",
    )
    subnets = spark.createDataFrame([("s1", "r", "a"), ("s2", "r", "b")], "subnet_id string, region string, zone string")
    asked = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "z")], "region string, zone string")
    out = K.zone_quota_headroom(gateways, subnets, asked, ["region"], quota=2)
    assert rows(out, "zone", "used", "passed") == [("a", 2, False), ("b", 0, True), ("z", 0, True)]


def test_gaps_come_in_the_order_of_the_requirement(spark):
    scopes = spark.createDataFrame([("p",), ("q",)], "project string")
    on = spark.createDataFrame([("p", "b"), ("p", "x")], "project string, item string")
    out = K.requirement_gaps(scopes, on, ["c", "b", "a"], ["project"])
    assert rows(out, "project", "missing", "passed") == [("p", ["c", "a"], False), ("q", ["c", "b", "a"], False)]


def test_gaps_by_zone(spark):
    asked = spark.createDataFrame([(1, "r", ["a", "b"]), (2, "r", ["a"])], "id int, region string, zones array<string>")
    offers = spark.createDataFrame([("r", "a", "m1"), ("r", "a", "m2"), ("r", "b", "m2")], "region string, zone string, item string")
    out = K.requirement_gaps_by_zone(asked, offers, ["m1", "m2"], ["region"])
    got = {r["id"]: ([tuple(m) for m in r["missing"]], r["missing_items"], r["passed"]) for r in out.collect()}
    assert got == {1: ([("b", "m1")], ["m1"], False), 2: ([], [], True)}


def listing(spark, *entries):
    data = [
        ("r", i, name, "virtualMachines", [(zones,)], [("Zone", barred)] if barred else [])
        for i, (name, zones, barred) in enumerate(entries)
    ]
    return spark.createDataFrame(
        data,
        "region string, position int, name string, resource_type string, "
        "location_info array<struct<zones:array<string>>>, restrictions array<struct<type:string,zones:array<string>>>",
    )


def common(spark, *entries, required=("s1", "s2"), **more):
    return [r[0] for r in rows(K.common_zones(listing(spark, *entries), required, ["region"], **more), "zone")]


def test_common_zones_ignore_skus_not_listed(spark):
    assert common(spark, ("s1", ["1", "2"], None)) == ["1", "2"]
    assert common(spark, ("s1", ["1", "2"], None), strict_missing=True) == []
    assert common(spark, ("s1", ["1", "2"], None), ("s2", ["2", "3"], None), strict_missing=True) == ["2"]
    assert common(spark, ("s1", ["1"], None), ("other", ["9"], None)) == ["1"]


def test_rows_of_a_sku_apply_in_listing_order(spark):
    assert common(spark, ("s1", ["1", "2"], ["1"])) == ["2"]
    assert common(spark, ("s1", ["1"], ["1"]), ("s1", ["1"], None)) == ["1"]
    assert common(spark, ("s1", ["1"], None), ("s1", [], ["1"])) == []
    # a SKU that is listed with no zone left empties the result
    assert common(spark, ("s1", ["1"], None), ("s2", ["1"], ["1"])) == []


def test_nested_search(spark):
    from invq.sources.schemas import SERVER_SKUS

    good = '{"supportedServerEditions":[{"name":"GeneralPurpose","supportedServerSkus":[{"name":"Standard_D2s_v3"}]}]}'
    cases = {
        "[]": "none",
        f"[{good}]": "present",
        '[{"reason":"RESTRICTED here"},' + good + "]": "restricted",
        '[{},{"reason":"restricted"},' + good + "]": "present",
        '[{"supportedServerEditions":[{"name":"Burstable","supportedServerSkus":[{"name":"Standard_D2s_v3"}]}]}]': "absent",
        "[{}]": "absent",
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string").withColumn("skus", F.from_json("t", SERVER_SKUS))
    assert {r["t"]: r["verdict"] for r in K.nested_sku_search(df).collect()} == cases


def test_no_failed_check_is_left_out(spark):
    failed = {1: ("Instance Types", "Unheard Of", "VPC Exists", "EKS Cluster Quota"), 2: ("vCPU Quota", "Another"), 3: ("VPC Quota",)}
    results = spark.createDataFrame(
        [(d, n, False) for d, names in failed.items() for n in names] + [(3, "VPC Quota", False), (4, "VPC DNS", True)],
        "deployment int, name string, passed boolean",
    )
    shapes = spark.createDataFrame(
        [(1, "aws_their_network"), (2, "azure"), (3, "no such shape"), (4, "gcp"), (5, None)], "deployment int, shape string"
    )
    out = K.preflight_rollup(results, shapes)
    assert rows(out, "deployment", "passed", "failed") == [
        (1, False, ["VPC Exists", "EKS Cluster Quota", "Instance Types", "Unheard Of"]), (2, False, ["vCPU Quota", "Another"]),
        (3, False, ["VPC Quota"]), (4, True, []), (5, True, []),
    ]


def test_saved_zones_are_kept_only_if_all_are_there(spark):
    df = spark.createDataFrame(
        [(1, "a, c"), (2, "a,z"), (3, ""), (4, None)], "id int, saved string"
    ).withColumn("available", F.array(*map(F.lit, "bac")))
    assert rows(K.zone_defaults(df), "id", "zones") == [(1, "a, c"), (2, "b,a"), (3, "b,a"), (4, "b,a")]


@pytest.mark.parametrize("code", ["RequestLimitExceeded", "InvalidSubnetRange", "NoCredentials"])
def test_only_a_refusal_refuses(spark, code):
    answers = spark.createDataFrame(
        [(1, "ec2:CreateSubnet", None, code), (2, "ec2:CreateSubnet", None, "UnauthorizedOperation")],
        "deployment int, action string, table_id string, error_code string",
    )
    shapes = spark.createDataFrame([(1, True), (2, True)], "deployment int, is_public boolean")
    verdicts = A.permission_verdicts(answers, shapes)
    assert rows(verdicts, "deployment", "verdict") == [(1, "unknown"), (2, "refused")]
    assert rows(A.permission_rollup(verdicts), "deployment", "passed") == [(1, True), (2, False)]


def test_tables_are_asked_about_once_and_route_tables_only_with_public_access(spark):
    answers = spark.createDataFrame(
        [(1, "ec2:AssociateRouteTable", t, "DryRunOperation") for t in ("one", "one", "two")]
        + [(d, "ec2:CreateRouteTable", None, "UnauthorizedOperation") for d in (1, 2)],
        "deployment int, action string, table_id string, error_code string",
    )
    shapes = spark.createDataFrame([(1, False), (2, True)], "deployment int, is_public boolean")
    got = rows(A.permission_verdicts(answers, shapes), "deployment", "action", "table_id", "verdict")
    assert got == [
        (1, "ec2:AssociateRouteTable", "one", "allowed"),
        (1, "ec2:AssociateRouteTable", "two", "allowed"),
        (2, "ec2:CreateRouteTable", None, "refused"),
    ]


def test_foreign_accounts(spark):
    ci, dev = "1" * 12, "2" * 12
    state = spark.createDataFrame(
        [("s", f'{{"a":"arn:aws:ec2:us-east-2:{ci}:vpc/x"}}'), ("s", f"arn:aws:iam::{ci}:role/y"), ("t", "urn:x::aws:ec2/vpc"), ("u", f"arn:aws:iam::{ci}:r")],
        "stack string, outputs string",
    )
    callers = spark.createDataFrame([("s", dev), ("t", dev), ("u", ci), ("none", dev)], "stack string, caller string")
    out = A.foreign_account_guard(state, callers)
    assert rows(out, "stack", "n_accounts", "violation") == [("none", 0, False), ("s", 1, True), ("t", 0, False), ("u", 1, False)]


def test_exposure(spark):
    shapes = spark.createDataFrame(
        [(1, "v1", False), (2, "v2", False), (3, "v3", True), (4, "v4", False)], "deployment int, vpc_id string, is_public boolean"
    )
    balancers = spark.createDataFrame([("v1", "internal"), ("v2", "internet-facing"), ("v3", "internet-facing")], "vpc_id string, scheme string")
    ingresses = spark.createDataFrame(
        [(1, "gloo-system", "private-gloo-lb"), (2, "gloo-system", "private-gloo-lb"), (4, "gloo-system", "gloo-lb"), (1, "else", "gloo-lb")],
        "deployment int, namespace string, name string",
    )
    out = A.exposure_audit(shapes, balancers, ingresses)
    assert rows(out, "deployment", "passed") == [(1, True), (2, False), (4, False)]


def test_resource_shapes(spark):
    def resources(stack, *types, urn="urn::pc-vpc", vpc="v"):
        return [(stack, t, urn, vpc) for t in types]

    own = [A.VPC, A.SUBNET, A.SUBNET, A.NAT, A.ROUTE_TABLE, A.ROUTE_TABLE]
    data = resources("own", *own) + resources("private", A.CIDR_ASSOCIATION) + resources("private", A.SUBNET, vpc="w")
    data += resources("own", "aws:eks/cluster:Cluster", urn="urn::pc-api-key")
    stacks = spark.createDataFrame(
        [("own", "own", 1, "v"), ("private", "private", 1, "v"), ("empty", "existing", 1, "v")],
        "stack string, shape string, n_zones int, expected_vpc_id string",
    )
    out = A.resource_shape_audit(spark.createDataFrame(data, "stack string, type string, urn string, vpc_id string"), stacks)
    failed = rows(out.where("not passed"), "stack", "check", "expected", "found")
    assert failed == [
        ("empty", A.ROUTE_TABLE, 1, 0), ("empty", A.SUBNET, 2, 0), ("empty", A.CIDR_ASSOCIATION, 1, 0),
        ("own", "forbidden name", 0, 1), ("own", "stray aws:eks", 0, 1), ("private", "foreign network", 0, 1),
    ]


def test_leftovers_and_their_cloud(spark):
    listed = spark.createDataFrame([("o/p/ci-gcp-1",), ("o/p/plain",), ("o/p/keep",), ("o/azure/aws",)], "qualified string")
    gone = spark.createDataFrame([("ci-gcp-1",), ("plain",), ("aws",), ("absent",)], "name string")
    assert rows(A.leftover_stacks(listed, gone), "name", "cloud") == [("aws", "aws"), ("ci-gcp-1", "gcp"), ("plain", "aws")]


def test_new_clusters(spark):
    clusters = spark.createDataFrame([("r", "a", "v1"), ("r", "b", "v2"), ("r", "c", "v2")], "region string, name string, vpc_id string")
    baseline = spark.createDataFrame([("r", "a")], "region string, name string")
    asked = spark.createDataFrame(
        [(1, "r", None, True), (2, "r", "v2", False), (3, "r", None, False), (4, "q", None, True)],
        "request_id int, region string, vpc_id string, has_baseline boolean",
    )
    out = A.baseline_new_keys(asked, clusters, baseline)
    assert rows(out, "request_id", "cluster", "status") == [
        (1, "b", "found"), (2, "b", "found"), (3, None, "refused"), (4, None, "none"),
    ]
