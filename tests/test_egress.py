import pytest
from pyspark.sql import functions as F

from invq.operators import egress as E
from invq.sources import schemas
from tests.helpers import rows

NAT, TGW, IGW, PCX, VGW = (
    {"NatGatewayId": "nat-1"},
    {"TransitGatewayId": "tgw-1"},
    {"GatewayId": "igw-1"},
    {"VpcPeeringConnectionId": "pcx-1"},
    {"GatewayId": "vgw-1"},
)


def route(target, state="active", destination="0.0.0.0/0"):
    return {"DestinationCidrBlock": destination, "State": state, **target}


def tables(spark, *specs):
    """(id, [subnets], main, [routes]) as nested listings of network v."""
    data = [
        {
            "RouteTableId": t,
            "VpcId": "v",
            "Associations": [{"SubnetId": s} for s in subnets] + ([{"Main": True}] if main else []),
            "Routes": routes,
        }
        for t, subnets, main, routes in specs
    ]
    import json

    text = spark.createDataFrame([(json.dumps(d),) for d in data], "t string")
    return text.select(F.from_json("t", schemas.ROUTE_TABLE).alias("table"))


def network(spark, *specs, zones=(("z1", None),), subnets=(("s1", "z1"), ("s2", "z1"), ("s3", "z2"))):
    nested = tables(spark, *specs)
    return (
        spark.createDataFrame([("v", z, n) for z, n in zones], "vpc_id string, zone string, named string"),
        spark.createDataFrame([(s, "v", z) for s, z in subnets], "subnet_id string, vpc_id string, zone string"),
        schemas.associations_of(nested),
        schemas.routes_of(nested),
    )


def zone_egress(spark, *specs, mode="live", **more):
    zones, subnets, associations, routes = network(spark, *specs, **more)
    out = E.zone_egress(zones, subnets, associations, E.table_egress(routes, mode), mode)
    return [r[1:] for r in rows(out, "zone", "status", "n_tables", "table_id", "target")]


@pytest.mark.parametrize(
    ("target", "usable"),
    [(NAT, "nat-1"), (TGW, "tgw-1"), (IGW, None), (PCX, None), (VGW, "vgw-1"), ({"NatGatewayId": "", "InstanceId": "i-1"}, "i-1")],
)
def test_route_target(spark, target, usable):
    routes = schemas.routes_of(tables(spark, ("t", [], False, [route(target), route(target, destination="10.0.0.0/8")])))
    assert [r["target"] for r in E.route_target(routes).orderBy("position").collect()] == [usable, None]


def test_modes_disagree_on_purpose(spark):
    dead_first = ("t", [], False, [route(NAT, "blackhole"), route(TGW)])
    unusable_first = ("u", [], False, [route(IGW), route(NAT)])
    routes = schemas.routes_of(tables(spark, dead_first, unusable_first))
    assert rows(E.table_egress(routes, "live"), "table_id", "target") == [("t", "tgw-1"), ("u", "nat-1")]
    assert rows(E.table_egress(routes, "declared"), "table_id", "target") == [("t", "nat-1")]
    with pytest.raises(ValueError):
        E.table_egress(routes, "guess")


def test_one_table_with_a_way_out_is_taken(spark):
    own = ("t1", ["s1"], False, [route(NAT)])
    assert zone_egress(spark, own) == [("egressing", 1, "t1", "nat-1")]
    public = ("t2", ["s2"], False, [route(IGW)])
    assert zone_egress(spark, own, public) == [("egressing", 1, "t1", "nat-1")]


def test_two_tables_with_a_way_out_are_ambiguous_unless_one_is_named(spark):
    specs = [("t1", ["s1"], False, [route(NAT)]), ("t2", ["s2"], False, [route(TGW)])]
    assert zone_egress(spark, *specs) == [("ambiguous", 2, "t1", "nat-1")]
    assert zone_egress(spark, *specs, zones=(("z1", "t2"),)) == [("egressing", 1, "t2", "tgw-1")]


def test_the_main_table_is_inherited_but_never_rescues_a_named_one(spark):
    main, public = ("m", [], True, [route(NAT)]), ("t", ["s1"], False, [route(IGW)])
    assert zone_egress(spark, main, public) == [("inherited_main", 0, "m", "nat-1")]
    assert zone_egress(spark, main, public, zones=(("z1", "t"),)) == [("silent", 1, "t", None)]
    assert zone_egress(spark, ("m", [], True, [route(IGW)]), public) == [("silent", 0, None, None)]
    assert zone_egress(spark, main, zones=(("z9", None),)) == [("inherited_main", 0, "m", "nat-1")]


def test_a_sole_main_table_counts_as_inherited_when_declared(spark):
    main = ("m", ["s1"], True, [route(NAT)])
    assert zone_egress(spark, main, mode="declared") == [("inherited_main", 1, "m", "nat-1")]
    assert zone_egress(spark, main) == [("egressing", 1, "m", "nat-1")]
    assert zone_egress(spark, ("t", ["s1"], False, [route(IGW)]), mode="declared") == [("inherited_main", 0, None, None)]


def test_ambiguous_zones_are_reported_before_silent_ones(spark):
    data = [("v", "ambiguous"), ("v", "silent"), ("w", "silent"), ("w", "egressing"), ("x", "inherited_main")]
    out = E.egress_verdict(spark.createDataFrame(data, "vpc_id string, status string"))
    assert rows(out, "vpc_id", "verdict", "passed") == [("v", "ambiguous", False), ("w", "silent", False), ("x", "ok", True)]


def test_associable_tables_leave_out_the_main_one(spark):
    specs = [("m", ["s1"], True, [route(NAT)]), ("t", ["s2"], False, [route(TGW)])]
    zones, subnets, associations, routes = network(spark, *specs, zones=(("z1", None), ("z2", "named")))
    out = E.associable_tables(zones, subnets, associations, E.table_egress(routes))
    assert rows(out, "zone", "table_id", "is_named") == [("z1", "t", False), ("z2", "named", True)]


def candidates(spark, *specs):
    zones, subnets, associations, routes = network(spark, *specs)
    out = E.zone_egress_candidates(zones, subnets, associations, routes)
    return rows(out, "table_id", "target", "usable", "inherited")


def test_candidates_name_unusable_tables_and_add_the_main_one(spark):
    public = ("t", ["s1"], False, [route(IGW), route(NAT)])
    assert candidates(spark, public) == [("t", "igw-1", False, False)]
    main = ("m", [], True, [route(TGW)])
    assert candidates(spark, public, main) == [("m", "tgw-1", True, True), ("t", "igw-1", False, False)]
    own = ("u", ["s2"], False, [route(NAT)])
    assert candidates(spark, public, main, own) == [("t", "igw-1", False, False), ("u", "nat-1", True, False)]
    silent = ("w", ["s1"], False, [route(NAT, "blackhole")])
    assert candidates(spark, silent) == []


def test_named_tables_go_on_top(spark):
    def df(*data):
        return spark.createDataFrame(list(data), "vpc_id string, zone string, table_id string")

    zones = df(("v", "a", None), ("v", "b", None))
    egress = spark.createDataFrame([("t1", "nat"), ("t2", "nat")], "table_id string, target string")
    out = E.override_merge(df(("v", "a", "t1"), ("v", "b", "t1")), df(("v", "b", "t9"), ("v", "c", "t2")), zones, egress)
    assert rows(out, "zone", "table_id", "source", "status") == [
        ("a", "t1", "detected", "ok"),
        ("b", "t9", "named", "warning"),
        ("c", "t2", "named", "rejected"),
    ]
