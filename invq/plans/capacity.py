"""Queries and checks for the quota and availability operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capacity as K
from ..sources.schemas import SERVER_SKUS
from .fixtures import fixture, oracle, supplied

ITEMS = ("5-LOW", "1-URGENT", "3-MEDIUM")
BRANDS = ("Brand#4", "Brand#1", "Brand#12", "Brand#7")
SKUS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "7-NONE")
GATEWAYS_PER_ZONE = 90


def quota_headroom(spark, sf_dir):
    usage = fixture(spark, sf_dir, "usage").where(
        (F.col("resource") != "balancer") | (F.col("kind") == "network")
    )
    return K.quota_headroom(usage, fixture(spark, sf_dir, "quota"), scope=("account",))


def quota_headroom_strict(spark, sf_dir):
    return K.quota_headroom(
        fixture(spark, sf_dir, "usage"), fixture(spark, sf_dir, "quota"), ("account",), strict_zero=True
    )


def core_headroom(spark, sf_dir):
    usages = supplied(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("region"),
        F.when(F.col("l_linenumber") <= 2, "cores").otherwise("other").alias("name"),
        (F.col("l_quantity") / 4).alias("current_value"),
        F.col("l_quantity").alias("quota"),
        F.struct(F.col("l_linenumber"), "l_quantity").alias("position"),
    )
    regions = supplied(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("region"))
    return K.core_headroom(usages, regions, ["region"])


def zone_quota_headroom(spark, sf_dir):
    wanted = fixture(spark, sf_dir, "range_wanted")
    requested = wanted.select("vpc_id", F.explode(F.sequence(F.lit(0), F.col("zones") - 1)).alias("zone"))
    return K.zone_quota_headroom(
        fixture(spark, sf_dir, "nat_gateway"),
        fixture(spark, sf_dir, "subnet_existing"),
        requested,
        ["vpc_id"],
        GATEWAYS_PER_ZONE,
    )


def requirement_gaps(spark, sf_dir):
    scopes = supplied(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"))
    out = K.requirement_gaps(scopes, fixture(spark, sf_dir, "enabled"), ITEMS, ["account"])
    return out.select("account", F.concat_ws(",", "missing").alias("missing"), "passed")


def _zone_requests(spark, sf_dir):
    df = fixture(spark, sf_dir, "zone_request")
    return df.withColumn("zones", F.split("zones", ",").cast("array<int>"))


def requirement_gaps_by_zone(spark, sf_dir):
    out = K.requirement_gaps_by_zone(
        _zone_requests(spark, sf_dir), fixture(spark, sf_dir, "offering"), BRANDS, ["account"]
    )
    pairs = F.transform("missing", lambda m: F.concat_ws(" in ", m["item"], m["zone"].cast("string")))
    return out.select(
        "request_id",
        F.concat_ws(",", pairs).alias("missing"),
        F.concat_ws(",", "missing_items").alias("missing_items"),
        "passed",
    )


def zone_gaps(spark, sf_dir):
    offered = fixture(spark, sf_dir, "offering").select("account", "zone")
    out = K.zone_gaps(_zone_requests(spark, sf_dir), offered, ["account"])
    return out.select("request_id", "zone")


def _sku_listing(spark, sf_dir):
    def zones(column):
        return F.filter(F.split(column, ","), lambda z: z != "")

    return fixture(spark, sf_dir, "sku_listing").select(
        "region",
        "position",
        "name",
        "resource_type",
        F.array(F.struct(zones("zones").alias("zones"))).alias("location_info"),
        F.array(
            F.struct(F.col("barred_by").alias("type"), zones("barred_zones").alias("zones"))
        ).alias("restrictions"),
    )


def unrestricted_skus(spark, sf_dir):
    return K.unrestricted_skus(_sku_listing(spark, sf_dir)).select("region", "position", "name")


def common_zones(spark, sf_dir):
    return K.common_zones(_sku_listing(spark, sf_dir), SKUS, ["region"])


def nested_sku_search(spark, sf_dir):
    listings = fixture(spark, sf_dir, "server_listing").withColumn(
        "skus", F.from_json("listing", SERVER_SKUS)
    )
    return K.nested_sku_search(listings).select("region", "verdict", "passed")


def preflight_rollup(spark, sf_dir):
    shape = (
        F.when(F.col("vpc_id") % 5 == 3, "gcp")
        .when(F.col("vpc_id") % 5 == 4, "azure")
        .when(F.col("vpc_id") % 50 == 1, "other")
        .when(F.col("in_their_network"), "aws_their_network")
        .otherwise("aws_own_network")
    )
    deployments = fixture(spark, sf_dir, "deployment").withColumn("shape", shape)
    out = K.preflight_rollup(fixture(spark, sf_dir, "check_result"), deployments)
    return out.select("deployment", "passed", "n_failed", F.concat_ws(",", "failed").alias("failed"))


def zone_defaults(spark, sf_dir):
    df = fixture(spark, sf_dir, "saved_zones").withColumn("available", F.split("available", ","))
    return K.zone_defaults(df).select("id", "zones")


QUERIES = {
    f.__name__: f
    for f in (
        quota_headroom,
        quota_headroom_strict,
        core_headroom,
        zone_quota_headroom,
        requirement_gaps,
        requirement_gaps_by_zone,
        zone_gaps,
        unrestricted_skus,
        common_zones,
        nested_sku_search,
        preflight_rollup,
        zone_defaults,
    )
}


def _listed(items):
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _headroom(where, quota):
    return f"""with used as (select account, resource, count(*) as used from usage where {where} group by all),
        q as (select account, resource, needed, coalesce(used, 0) as used, cast(trunc({quota}) as bigint) as quota
              from quota left join used using (account, resource))
        select account, resource, used, quota, quota - used as available, quota - used >= needed as passed from q"""


ORACLES = {
    "quota_headroom": oracle(
        _headroom(
            "resource <> 'balancer' or kind = 'network'",
            "case when coalesce(applied, provider_default, 0) = 0 then fallback else coalesce(applied, provider_default) end",
        ),
        "usage",
        "quota",
    ),
    "quota_headroom_strict": oracle(
        _headroom("true", "coalesce(applied, provider_default, fallback)"), "usage", "quota"
    ),
    "core_headroom": """
        with c as (select l_orderkey as region, cast(trunc(l_quantity) as bigint) - cast(trunc(l_quantity / 4) as bigint) as a,
                          row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) as nr
                   from lineitem where l_linenumber <= 2)
        select o_orderkey as region, a as available, coalesce(a >= 8, true) as passed
        from orders left join c on o_orderkey = region and nr = 1""",
    "zone_quota_headroom": oracle(
        f"""with asked as (select distinct vpc_id, cast(zone as int) as zone from range_wanted
                          join (select unnest(range(0, 3)) as zone) z on zone < zones),
            u as (select vpc_id, zone, count(*) as n from nat_gateway join subnet_existing using (subnet_id)
                  where state <> 'deleted' group by vpc_id, zone)
            select vpc_id, zone, coalesce(n, 0) as used, {GATEWAYS_PER_ZONE} - coalesce(n, 0) as available,
                   {GATEWAYS_PER_ZONE} - coalesce(n, 0) >= 1 as passed
            from asked left join u using (vpc_id, zone)""",
        "range_wanted",
        "subnet_existing",
        "nat_gateway",
    ),
    "requirement_gaps": oracle(
        f"""with need as (select unnest({_listed(ITEMS)}) as item, unnest(range(0, {len(ITEMS)})) as i),
            gap as (select c_custkey as account, item, i from customer, need
                    where not exists (select 1 from enabled e where e.account = c_custkey and e.item = need.item))
            select c_custkey as account, coalesce(string_agg(item, ',' order by i), '') as missing, count(item) = 0 as passed
            from customer left join gap on c_custkey = account group by c_custkey""",
        "enabled",
    ),
    "requirement_gaps_by_zone": oracle(
        f"""with need as (select unnest({_listed(BRANDS)}) as item, unnest(range(0, {len(BRANDS)})) as i),
            asked as (select request_id, account, cast(unnest(string_split(zones, ',')) as int) as zone,
                             unnest(range(0, len(string_split(zones, ',')))) as zi from zone_request),
            had as (select distinct account, zone, item from offering),
            gap as (select request_id, zone, zi, n.item, i from asked a, need n where not exists
                    (select 1 from had h where h.account = a.account and h.zone = a.zone and h.item = n.item)),
            items as (select request_id, string_agg(item, ',' order by i) as missing_items
                      from (select distinct request_id, item, i from gap) d group by request_id),
            pairs as (select request_id, string_agg(item || ' in ' || zone, ',' order by zi, i) as missing from gap group by request_id)
            select request_id, coalesce(missing, '') as missing, coalesce(missing_items, '') as missing_items,
                   missing is null as passed
            from zone_request left join items using (request_id) left join pairs using (request_id)""",
        "zone_request",
        "offering",
    ),
    "zone_gaps": oracle(
        """with asked as (select request_id, account, cast(unnest(string_split(zones, ',')) as int) as zone from zone_request)
           select request_id, zone from asked a where not exists
             (select 1 from (select distinct account, zone from offering) h where h.account = a.account and h.zone = a.zone)""",
        "zone_request",
        "offering",
    ),
    "unrestricted_skus": oracle(
        "select region, position, name from sku_listing where resource_type = 'virtualMachines' and barred_by <> 'Location'",
        "sku_listing",
    ),
    "common_zones": oracle(
        f"""with m as (select * from sku_listing where resource_type = 'virtualMachines' and list_contains({_listed(SKUS)}, name)),
            said as (select region, name, position, unnest(string_split(zones, ',')) as zone, false as gone from m
                     union all select region, name, position, unnest(string_split(barred_zones, ',')), true from m
                     where barred_by = 'Zone'),
            word as (select region, name, zone, gone, row_number() over (partition by region, name, zone
                       order by position desc, gone desc) as nr from said where zone <> ''),
            seen as (select region, count(distinct name) as n_seen from m group by region),
            hit as (select region, zone, count(*) as n from word where nr = 1 and not gone group by region, zone)
            select region, zone, n_seen from hit join seen using (region) where n = n_seen""",
        "sku_listing",
    ),
    "nested_sku_search": oracle(
        """with l as (select region, cast(json(listing) as json[]) as caps from server_listing),
           s as (select region, json_extract_string(e, '$.name') as edition,
                        unnest(cast(json_extract(e, '$.supportedServerSkus') as json[])) as sku
                 from (select region, unnest(cast(json_extract(c, '$.supportedServerEditions') as json[])) as e
                       from (select region, unnest(caps) as c from l) x) y),
           hit as (select distinct region from s where edition = 'GeneralPurpose' and json_extract_string(sku, '$.name') = 'Standard_D2s_v3'),
           v as (select l.region, case when len(caps) = 0 then 'none'
                   when lower(coalesce(json_extract_string(caps[1], '$.reason'), '')) like '%restricted%' then 'restricted'
                   when h.region is not null then 'present' else 'absent' end as verdict
                 from l left join hit h on l.region = h.region)
           select region, verdict, verdict = 'present' as passed from v""",
        "server_listing",
    ),
    "preflight_rollup": oracle(
        """with checks as (
             select 'aws_own_network' as shape, unnest(['VPC Quota', 'Elastic IPs', 'NAT Gateways', 'Internet Gateways',
                    'EKS Cluster Quota', 'Network Load Balancers', 'Availability Zones', 'Instance Types', 'VPC CIDR']) as name,
                    unnest(range(0, 9)) as i
             union all
             select 'aws_their_network', unnest(['VPC Exists', 'VPC DNS', 'VPC CIDR', 'VPC Permissions', 'Subnet Egress',
                    'EKS Cluster Quota', 'Internet Gateway', 'Network Load Balancers', 'Availability Zones', 'Instance Types']),
                    unnest(range(0, 10))
             union all
             select 'gcp', unnest(['GCP APIs', 'VPC Networks', 'External IPs', 'GKE Clusters', 'Machine Types',
                    'Availability Zones', 'VPC CIDR']), unnest(range(0, 7))
             union all
             select 'azure', unnest(['Resource Providers', 'PostgreSQL Flexible Server', 'vCPU Quota', 'AKS Clusters',
                    'VM SKUs', 'Availability Zones', 'VNet CIDR']), unnest(range(0, 7))),
            shaped as (select deployment, case when vpc_id % 5 = 3 then 'gcp' when vpc_id % 5 = 4 then 'azure'
                         when vpc_id % 50 = 1 then 'other' when in_their_network then 'aws_their_network'
                         else 'aws_own_network' end as shape from deployment),
            bad as (select distinct deployment, name from check_result where not passed),
            f as (select deployment, count(*) as n, string_agg(name, ',' order by coalesce(i, 99), name) as names
                  from bad join shaped using (deployment) left join checks using (shape, name) group by deployment)
            select deployment, n is null as passed, coalesce(n, 0) as n_failed, coalesce(names, '') as failed
            from deployment left join f using (deployment)""",
        "deployment",
        "check_result",
    ),
    "zone_defaults": oracle(
        """with z as (select id, saved, available, string_split(available, ',') as a, string_split(replace(saved, ' ', ''), ',') as s from saved_zones)
           select id, case when coalesce(saved, '') <> '' and list_has_all(a, s) then saved
                           else array_to_string(a[1:2], ',') end as zones from z""",
        "saved_zones",
    ),
}
