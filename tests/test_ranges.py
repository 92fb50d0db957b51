import ipaddress
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from invq.functions import cidr as C
from invq.operators import ranges as R
from invq.plans import registry
from tests.helpers import NET, net, rows, text_of


def requests(spark, *specs):
    data = [(i, v, net(c), list(z), p) for i, v, c, z, p in specs]
    return spark.createDataFrame(
        data, f"range_id int, vpc_id string, net {NET}, zones array<string>, is_public boolean"
    )


def subnets(spark, *specs):
    data = [(s, v, net(c), ours) for s, v, c, ours in specs]
    return spark.createDataFrame(
        data, f"subnet_id string, vpc_id string, net {NET}, is_ours boolean"
    )


def blocks(spark, vpc, *cidrs, state="associated"):
    return spark.createDataFrame(
        [(vpc, state, net(c)) for c in cidrs], f"vpc_id string, state string, net {NET}"
    )


@pytest.mark.parametrize(
    "text",
    [
        "10.0.0.0/16", "10.0.0.1", "0.0.0.0/0", "255.255.255.255/32", "10.0.0.1/16", "10.0.0/16",
        "10.0.0.0/33", "010.0.0.0/16", "10.256.0.0/16", "fd00::/16", "10.0.0.0/255.255.0.0", "",
        " 10.0.0.0/16", "10.0.0.0/16 ", "10.0.0.0/16\n", "10.0.0.0/", "10.0.0.0/08", "x", "1.2.3.4/5/6",
        "192.168.255.254/31", "10.0.0.0/-1",
    ],
)
def test_parse_is_strict(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(C.parse_cidr(F.col("t")).alias("n"))
    try:
        parsed = ipaddress.IPv4Network(text)
    except ValueError:
        parsed = None
    if text.count(".") == 6:
        parsed = None  # netmask notation is not read
    assert text_of(got.first()["n"]) == (None if parsed is None else str(parsed))


def test_policy_names_the_first_rule_broken(spark):
    data = [
        ("nonsense", 9), ("192.168.16.0/21", 9), ("10.0.0.0/8", 1), ("10.0.0.0/16", 4),
        ("11.0.0.0/16", 3), ("172.31.0.0/16", 3), ("192.168.16.0/20", 1), ("172.32.0.0/16", 1),
    ]
    out = R.range_policy_audit(spark.createDataFrame(data, "cidr string, zones int"))
    assert [r["verdict"] for r in out.collect()] == [
        "invalid", "prefix", "prefix", "zones", "not_private", "ok", "ok", "not_private",
    ]


@pytest.mark.parametrize(
    ("cidr", "public", "private"),
    [
        (
            "10.0.0.0/16",
            ["10.0.0.0/20", "10.0.16.0/20", "10.0.32.0/20"],
            ["10.0.64.0/18", "10.0.128.0/18", "10.0.192.0/18"],
        ),
        (
            "192.168.16.0/20",
            ["192.168.16.0/26", "192.168.17.0/26", "192.168.18.0/26"],
            ["192.168.20.0/22", "192.168.24.0/22", "192.168.28.0/22"],
        ),
    ],
)
def test_layout(spark, cidr, public, private):
    out = R.subnet_layout(requests(spark, (1, "v", cidr, "abc", True)))
    got = {(r["kind"], r["zone_index"]): text_of(r["subnet"]) for r in out.collect()}
    assert [got["public", i] for i in range(3)] == public
    assert [got["private", i] for i in range(3)] == private


def test_layout_past_the_last_slot_is_null(spark):
    out = R.subnet_layout(requests(spark, (1, "v", "10.0.0.0/16", "abcd", False)))
    assert [text_of(r["subnet"]) is None for r in out.orderBy("zone").collect()] == [False] * 3 + [True]


@pytest.mark.parametrize("prefix", range(16, 21))
def test_layout_stays_inside_and_apart(spark, prefix):
    out = R.subnet_layout(requests(spark, (1, "v", f"10.32.0.0/{prefix}", "abc", True)))
    nets = [ipaddress.IPv4Network(text_of(r["subnet"])) for r in out.collect()]
    whole = ipaddress.IPv4Network(f"10.32.0.0/{prefix}")
    assert all(n.subnet_of(whole) for n in nets)
    assert not any(a.overlaps(b) for i, a in enumerate(nets) for b in nets[:i])


def collisions(spark, cidr, public, *existing):
    planned = R.subnet_layout(requests(spark, (1, "v", cidr, "ab", public)))
    found = R.range_overlap(planned, subnets(spark, *existing)).collect()
    return sorted((text_of(r["subnet"]), r["subnet_id"]) for r in found)


def test_a_planned_subnet_collides_with_theirs_but_not_with_ours(spark):
    theirs, ours = ("s", "v", "10.1.4.0/24", False), ("s", "v", "10.1.4.0/24", True)
    assert collisions(spark, "10.1.0.0/20", False, theirs) == [("10.1.4.0/22", "s")]
    assert collisions(spark, "10.1.0.0/20", False, ours) == []
    assert collisions(spark, "10.1.0.0/20", False, ("s", "w", "10.1.4.0/24", False)) == []


def test_only_slots_that_are_cut_are_asked_about(spark):
    in_public, in_spare = ("s", "v", "10.1.0.0/26", False), ("s", "v", "10.1.3.0/24", False)
    assert collisions(spark, "10.1.0.0/20", True, in_public) == [("10.1.0.0/26", "s")]
    assert collisions(spark, "10.1.0.0/20", False, in_public) == []
    assert collisions(spark, "10.1.0.0/20", True, in_spare) == []


def random_net(rng, shortest, longest):
    prefix = rng.randint(shortest, longest)
    lo = (rng.choice([10 << 24, 172 << 24]) + rng.randrange(2**18)) >> (32 - prefix) << (32 - prefix)
    return (lo, prefix)


@pytest.mark.parametrize(("seed", "hot_rows"), [(1, 10**6), (2, 10**6), (3, 2), (4, 1)])
def test_overlap_join_equals_brute_force(spark, seed, hot_rows):
    rng = random.Random(seed)
    left = [(i, rng.randrange(2), random_net(rng, 4, 28)) for i in range(120)]
    right = [(i, rng.randrange(2), random_net(rng, 4, 28)) for i in range(150)]
    # copies of one block: the hot keys
    left += [(1000 + i, 0, left[0][2]) for i in range(7)]
    right += [(1000 + i, 0, right[0][2]) for i in range(9)] + [(2000, 0, (0, 0)), (2001, 1, (0, 1))]
    a = spark.createDataFrame(left, f"a int, vpc_id int, l_net {NET}")
    b = spark.createDataFrame(right, f"b int, vpc_id int, r_net {NET}")
    got = rows(R.overlap_join(a, b, ["vpc_id"], "l_net", "r_net", hot_rows=hot_rows), "a", "b")

    def hit(x, y):
        return x[0] < y[0] + 2 ** (32 - y[1]) and y[0] < x[0] + 2 ** (32 - x[1])

    want = [(i, j) for i, v, x in left for j, w, y in right if v == w and hit(x, y)]
    assert got == sorted(want, key=repr)


def test_distinct_overlapping_pairs_are_linear(spark):
    """A chain of nested blocks on both sides: each block meets its ancestors and descendants."""
    nets = [((10 << 24), p) for p in range(8, 33)]
    one = spark.createDataFrame([(0, n, 1) for n in nets], f"v int, l {NET}, ln int")
    two = one.withColumnsRenamed({"l": "r", "ln": "rn"})
    assert R.net_pairs(one, two, ["v"]).count() == len(nets) ** 2
    assert len(nets) ** 2 <= 33 * 2 * len(nets)


def placement(spark, cidr, carried, *existing):
    out = R.range_placement_verdict(
        requests(spark, (1, "v", cidr, "ab", False)),
        blocks(spark, "v", *carried),
        subnets(spark, *(existing or [("none", "w", "10.0.0.0/24", False)])),
    )
    return out.first()["verdict"], out.first()["passed"]


def test_placement_verdicts(spark):
    assert placement(spark, "10.0.16.0/20", ["10.0.0.0/16"]) == ("covered", True)
    assert placement(spark, "10.0.0.0/16", ["10.0.0.0/20"]) == ("partial_overlap", False)
    assert placement(spark, "10.1.0.0/16", ["192.168.0.0/16"]) == ("wrong_family", False)
    assert placement(spark, "10.1.0.0/16", ["10.0.0.0/16"]) == ("free", True)
    assert placement(spark, "10.1.0.0/16", ["100.64.0.0/16"]) == ("free", True)
    theirs = ("s", "v", "10.0.20.0/24", False)
    assert placement(spark, "10.0.16.0/20", ["10.0.0.0/16"], theirs) == ("taken", False)


def test_only_associated_blocks_count(spark):
    out = R.range_placement_verdict(
        requests(spark, (1, "v", "10.1.0.0/16", "a", False)),
        blocks(spark, "v", "10.1.0.0/16", "192.168.0.0/16", state="disassociated"),
        subnets(spark, ("s", "w", "10.0.0.0/24", False)),
    )
    assert out.first()["verdict"] == "free"


def test_suggestion(spark):
    def suggest(*cidrs):
        return text_of(R.free_range_suggest(blocks(spark, "v", *cidrs)).first()["suggested"])

    assert suggest("10.0.0.0/16", "10.1.0.0/16") == "10.2.0.0/16"
    assert suggest("172.16.0.0/16") == "172.17.0.0/16"
    assert suggest("192.168.0.0/24") is None
    assert suggest("10.0.0.0/8", "172.16.0.0/13") == "172.24.0.0/16"
    assert suggest("8.0.0.0/5", "10.3.0.0/24") is None
    assert suggest("100.64.0.0/16") is None
    unreadable = spark.createDataFrame([("v", None)], f"vpc_id string, net {NET}")
    assert R.free_range_suggest(unreadable).collect()[0]["suggested"] is None


def test_neighbours(spark):
    def derive(text):
        row = R.adjacent_range_derive(spark.createDataFrame([(net(text),)], f"net {NET}")).first()
        return row["verdict"], text_of(row["db"]), text_of(row["link"])

    assert derive("10.0.0.0/16") == ("ok", "10.1.0.0/16", "10.2.0.0/27")
    assert derive("255.255.0.0/16")[0] == "overflow"
    assert derive("255.254.0.0/16")[0] == "overflow"
    assert derive("255.253.0.0/16") == ("ok", "255.254.0.0/16", "255.255.0.0/27")
    assert derive("10.0.0.0/28") == ("ok", "10.0.0.16/28", "10.0.0.32/27")
    assert derive("10.0.0.16/28")[0] == "unaligned"


def test_reserved_blocks(spark):
    df = spark.createDataFrame([(net("10.100.0.0/16"),), (net("10.100.2.0/25"),), (net("10.101.0.0/16"),)], f"net {NET}")
    out = R.reserved_range_conflicts(df)
    assert [r["conflicts"] for r in out.collect()] == [["10.100.1.0/24", "10.100.2.0/24"], ["10.100.2.0/24"], []]


def test_fleet_conflicts_skip_what_cannot_be_read_and_pass_when_unattended(spark):
    asked = spark.createDataFrame(
        [(1, "a", net("10.0.0.0/16"), False), (2, "a", net("10.0.0.0/16"), True), (3, "b", net("10.0.0.0/16"), False)],
        f"range_id int, account string, net {NET}, non_interactive boolean",
    )
    networks = spark.createDataFrame(
        [("a", ["10.0.4.0/24", "bad", "10.0.1.2/8"]), ("a", ["10.0.0.0/8"]), ("b", ["10.1.0.0/16", None])],
        "account string, prefixes array<string>",
    )
    out = R.fleet_range_conflicts(asked, networks)
    assert rows(out, "range_id", "n_conflicts", "first_conflict", "passed") == [
        (1, 2, "10.0.0.0/8", False),
        (2, 2, "10.0.0.0/8", True),
        (3, 0, None, True),
    ]


@pytest.mark.parametrize("seed", range(6))
def test_collapse_equals_the_library(spark, seed):
    rng = random.Random(seed)
    nets = [random_net(rng, rng.choice([6, 15, 17]), 32) for _ in range(rng.choice([5, 60, 300]))]
    nets += [(10 << 24 | i << 16, 16) for i in range(rng.randrange(5))]
    data = [(g, n) for g in (0, 1) for n in nets if rng.random() < 0.8]
    out = R.range_collapse(spark.createDataFrame(data, f"vpc_id int, net {NET}"))
    for g in (0, 1):
        want = ipaddress.collapse_addresses([ipaddress.IPv4Network(n) for h, n in data if h == g])
        got = [text_of(r["net"]) for r in out.where(F.col("vpc_id") == g).collect()]
        assert sorted(got) == sorted(map(str, want))


def test_collapse_example(spark):
    df = blocks(spark, "v", "10.0.0.0/16", "10.1.0.0/16", "10.2.0.0/27")
    assert sorted(text_of(r["net"]) for r in R.range_collapse(df).collect()) == ["10.0.0.0/15", "10.2.0.0/27"]


def test_layout_integrity(spark):
    asked = requests(
        spark, (1, "v", "10.0.0.0/16", "ab", True), (2, "v", "10.0.0.0/16", "a", False), (3, "v", "10.0.0.0/16", "a", False)
    )
    good = R.subnet_layout(asked).select("range_id", "zone", "subnet").where("range_id < 3")
    bad = spark.createDataFrame(
        [(2, "a", net("10.0.64.0/18")), (2, "x", net("11.0.0.0/24"))], f"range_id int, zone string, subnet {NET}"
    )
    out = R.layout_integrity_audit(asked, good.unionByName(bad))
    assert rows(out, "range_id", "n_outside", "n_wrong_zones", "n_overlap_pairs", "passed") == [
        (1, 0, 0, 0, True),
        (2, 1, 2, 1, False),
        (3, 0, 1, 0, False),
    ]


@pytest.fixture
def ancestors(monkeypatch):
    """Blocks meet their ancestors however few there are."""
    monkeypatch.setattr(R, "FEW_BLOCKS", 0)


@pytest.mark.parametrize(
    "name",
    ["range_overlap", "range_overlap_free", "range_placement_verdict", "fleet_range_conflicts", "layout_integrity_audit"],
)
def test_both_ways_give_the_same_rows(spark, name, ancestors):
    sf = "/root/testdata/sf0.001"
    by_ancestors = rows(registry.QUERIES[name](spark, sf), "*")
    R.FEW_BLOCKS = 10**9  # undone by the fixture
    assert rows(registry.QUERIES[name](spark, sf), "*") == by_ancestors and by_ancestors


def test_scopes_are_counted_before_blocks_are_compared(spark):
    few = spark.range(64).select((F.col("id") % 2).alias("v"), "id")
    assert R.few_per_scope(few, ["v"])
    assert not R.few_per_scope(few.union(spark.range(1).select(F.lit(1).alias("v"), "id")), ["v"])
    assert R.few_per_scope(spark.range(100).select(F.lit(None).cast("int").alias("v")), ["v"])


def test_many_equal_planned_blocks_meet_one_existing(spark, ancestors):
    planned = spark.range(500).select(F.lit(1).alias("vpc_id"), "id", C.parse_cidr(F.lit("10.0.0.0/24")).alias("subnet"))
    there = spark.createDataFrame([(1, "s", "10.0.0.128/25")], "vpc_id int, subnet_id string, cidr string")
    there = there.select("vpc_id", "subnet_id", C.parse_cidr(F.col("cidr")).alias("existing"))
    dealt = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in dealt}
    largest = {}
    try:
        for k, v in dealt.items():
            spark.conf.set(k, v)
        for hot_rows in (10, 10**6):
            out = R.overlap_join(planned, there, ["vpc_id"], "subnet", "existing", hot_rows=hot_rows)
            found = out.select("id", F.spark_partition_id().alias("part")).collect()
            assert sorted(r["id"] for r in found) == list(range(500))
            largest[hot_rows] = max(Counter(r["part"] for r in found).values())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # cut into slices the block is spread over the partitions; whole it lies in one
    assert largest[10] < 200 and largest[10**6] == 500


@pytest.mark.parametrize("name", ["range_overlap", "range_overlap_free", "resource_shape_audit_landed"])
def test_exploded_sides_are_merged_not_broadcast(spark, name, monkeypatch):
    """The planner takes an exploded side for as small as what it is made from."""
    monkeypatch.setattr(R, "FEW_BLOCKS", 10**9)
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert any("SortMergeJoin" in line for line in joins)
    if name != "range_overlap_free":  # its last join is of whole requests, not of exploded ones
        assert not any("vpc_id" in line or "stack" in line for line in joins if "BroadcastHashJoin" in line)


def test_partitions_grow_with_the_tables(spark, monkeypatch):
    from invq import session as S

    assert S.sized(spark, "/root/testdata/sf0.001") is spark
    monkeypatch.setattr(S, "PARTITION_BYTES", 1000)
    other = S.sized(spark, "/root/testdata/sf0.001")
    assert int(other.conf.get("spark.sql.shuffle.partitions")) > 100
    assert other.conf.get("spark.sql.session.timeZone") == "UTC" and int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
