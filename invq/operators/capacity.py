"""Quota and availability questions: counting, set difference, ordered lists.

Counts are combined before every shuffle. Lists that come out as arrays are bounded by a list
the caller gives (required items, requested zones) or, for failed checks, by how many kinds of
check there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import hot_join

# fixed values: what a deployment needs, in the order it is reported
REQUIRED_MACHINES = {
    "aws": ("m6idn.large", "i7ie.large", "m6idn.xlarge", "r6in.large", "r6i.large"),
    "gcp": ("n2-standard-4", "n2-standard-2", "n2-highmem-2"),
    "azure": ("Standard_D4s_v5", "Standard_L2aos_v4", "Standard_L2s_v4", "Standard_L4s_v4"),
}
REQUIRED_APIS = (
    "autoscaling.googleapis.com",
    "cloudapis.googleapis.com",
    "cloudkms.googleapis.com",
    "cloudresourcemanager.googleapis.com",
    "compute.googleapis.com",
    "container.googleapis.com",
    "dns.googleapis.com",
    "domains.googleapis.com",
    "iam.googleapis.com",
    "iamcredentials.googleapis.com",
    "networkmanagement.googleapis.com",
    "secretmanager.googleapis.com",
    "servicedirectory.googleapis.com",
    "servicemanagement.googleapis.com",
    "siteverification.googleapis.com",
    "storage.googleapis.com",
)
REQUIRED_PROVIDERS = (
    "Microsoft.Compute",
    "Microsoft.ContainerService",
    "Microsoft.DBforPostgreSQL",
    "Microsoft.Storage",
    "Microsoft.Network",
    "Microsoft.KeyVault",
    "Microsoft.ManagedIdentity",
    "Microsoft.Authorization",
)
# fixed values: limits used where none is known, and the server SKU looked for
DEFAULT_LIMITS = {
    "VPC Quota": 5,
    "Elastic IPs": 5,
    "NAT Gateways": 5,
    "Internet Gateways": 5,
    "Network Load Balancers": 50,
    "EKS Cluster Quota": 100,
    "VPC Networks": 15,
    "External IPs": 8,
    "GKE Clusters": 50,
    "AKS Clusters": 100,
}
MIN_CORES = 8
SERVER_EDITION = "GeneralPurpose"
SERVER_SKU = "Standard_D2s_v3"
ZONES_OFFERED = 2

# fixed values: the checks of each deployment shape, in order, by the names their results carry
CHECK_ORDERS = {
    "aws_own_network": (
        "VPC Quota",
        "Elastic IPs",
        "NAT Gateways",
        "Internet Gateways",
        "EKS Cluster Quota",
        "Network Load Balancers",
        "Availability Zones",
        "Instance Types",
        "VPC CIDR",
    ),
    "aws_their_network": (
        "VPC Exists",
        "VPC DNS",
        "VPC CIDR",
        "VPC Permissions",
        "Subnet Egress",
        "EKS Cluster Quota",
        "Internet Gateway",
        "Network Load Balancers",
        "Availability Zones",
        "Instance Types",
    ),
    "gcp": (
        "GCP APIs",
        "VPC Networks",
        "External IPs",
        "GKE Clusters",
        "Machine Types",
        "Availability Zones",
        "VPC CIDR",
    ),
    "azure": (
        "Resource Providers",
        "PostgreSQL Flexible Server",
        "vCPU Quota",
        "AKS Clusters",
        "VM SKUs",
        "Availability Zones",
        "VNet CIDR",
    ),
}


def effective_limit(strict_zero: bool = False) -> Column:
    """The limit in force, whole: applied, else the provider's default, else the fallback.

    A limit of zero counts as unknown and gives the fallback, unless ``strict_zero``.
    """
    known = F.coalesce("applied", "provider_default")
    if not strict_zero:
        known = F.nullif(known, F.lit(0.0))
    return F.coalesce(known, F.col("fallback").cast("double")).cast("bigint")


def quota_headroom(
    usage: DataFrame,
    limits: DataFrame,
    scope: Sequence[str] = ("account", "region"),
    used: str | None = None,
    strict_zero: bool = False,
) -> DataFrame:
    """Per scope and resource with a limit: used, limit, available and whether enough is left.

    ``usage`` has one row per thing in use, or an amount in column ``used``. Scopes that use
    nothing are kept: the limits lead.
    """
    keys = [*scope, "resource"]
    amount = F.count(F.lit(1)) if used is None else F.sum(F.col(used).cast("bigint"))
    in_use = usage.groupBy(*keys).agg(amount.alias("used"))
    available = F.col("quota") - F.col("used")
    return (
        limits.join(in_use, keys, "left")
        .withColumn("used", F.coalesce("used", F.lit(0).cast("bigint")))
        .withColumn("quota", effective_limit(strict_zero))
        .withColumn("available", available)
        .withColumn("passed", F.col("available") >= F.col("needed"))
        .select(*keys, "used", "quota", "available", "passed")
    )


def core_headroom(usages: DataFrame, regions: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Cores left per region from a usage listing (``name, current_value, quota, position``).

    The first ``cores`` row of a listing counts. A region without one passes: unknown.
    """
    cores = (
        usages.where(F.col("name") == "cores")
        .groupBy(*scope)
        .agg(
            F.min_by(
                F.coalesce("quota", F.lit(0)).cast("bigint")
                - F.coalesce("current_value", F.lit(0)).cast("bigint"),
                "position",
            ).alias("available")
        )
    )
    return (
        regions.select(*scope)
        .join(cores, list(scope), "left")
        .withColumn("passed", F.coalesce(F.col("available") >= MIN_CORES, F.lit(True)))
    )


def zone_quota_headroom(
    gateways: DataFrame,
    subnets: DataFrame,
    requested: DataFrame,
    scope: Sequence[str],
    quota: int = DEFAULT_LIMITS["NAT Gateways"],
) -> DataFrame:
    """Live gateways per requested zone against the quota per zone, zones with none included.

    Gateways are counted per subnet before they meet the subnets' zones, so a subnet with most
    of the gateways arrives as one row per map task.
    """
    keys = [*scope, "zone"]
    per_subnet = (
        gateways.where(F.col("state").isin("available", "pending") & F.col("subnet_id").isNotNull())
        .groupBy("subnet_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_zone = (
        per_subnet.join(subnets.select("subnet_id", *keys), "subnet_id")
        .groupBy(*keys)
        .agg(F.sum("n").alias("used"))
    )
    return (
        requested.select(*keys)
        .distinct()
        .join(per_zone, keys, "left")
        .withColumn("used", F.coalesce("used", F.lit(0).cast("bigint")))
        .withColumn("available", quota - F.col("used"))
        .withColumn("passed", F.col("available") >= 1)
    )


def unrestricted_skus(listing: DataFrame) -> DataFrame:
    """Machine SKUs that no restriction keeps out of the location."""
    barred = F.exists(
        F.coalesce("restrictions", F.array().cast(listing.schema["restrictions"].dataType)),
        lambda r: F.coalesce(r["type"] == "Location", F.lit(False)),
    )
    return listing.where((F.col("resource_type") == "virtualMachines") & ~barred)


def requirement_gaps(
    scopes: DataFrame,
    available: DataFrame,
    required: Sequence[str],
    scope: Sequence[str],
    item: str = "item",
) -> DataFrame:
    """Per scope: the required items not available there, in the order they are required.

    Only required items are kept of ``available``, so a scope's set has at most len(required)
    members and is built in the map tasks.
    """
    present = (
        available.where(F.col(item).isin(*required))
        .groupBy(*scope)
        .agg(F.collect_set(item).alias("present"))
    )
    wanted = F.array(*[F.lit(r) for r in required])
    found = F.coalesce("present", F.array().cast("array<string>"))
    return (
        hot_join(scopes, present, scope, "left")
        .withColumn("missing", F.array_except(wanted, found))
        .withColumn("passed", F.size("missing") == 0)
        .drop("present")
    )


def requirement_gaps_by_zone(
    requests: DataFrame,
    offerings: DataFrame,
    required: Sequence[str],
    scope: Sequence[str],
    zones: str = "zones",
    item: str = "item",
    zone: str = "zone",
) -> DataFrame:
    """Per request: required items not offered in each of its zones.

    Adds ``missing`` (structs of zone and item, by zone then requirement) and
    ``missing_items`` (items lacking in some zone, in order of requirement).
    Offerings are cut to required items and requested zones before they are grouped.
    """
    scope = list(scope)
    asked_zones = requests.select(*scope, F.explode(zones).alias(zone)).distinct()
    offered = (
        offerings.where(F.col(item).isin(*required))
        .select(*scope, zone, item)
        .distinct()
        .join(asked_zones, [*scope, zone], "left_semi")
        .groupBy(*scope)
        .agg(F.collect_set(F.struct(F.col(zone).alias("zone"), F.col(item).alias("item"))).alias("offered"))
    )
    wanted = F.array(*[F.lit(r) for r in required])
    zone_type = requests.schema[zones].dataType.elementType.simpleString()
    pairs = F.flatten(
        F.transform(
            F.col(zones),
            lambda z: F.transform(wanted, lambda r: F.struct(z.alias("zone"), r.alias("item"))),
        )
    )
    none = F.array().cast(f"array<struct<zone:{zone_type},item:string>>")
    return (
        hot_join(requests, offered, scope, "left")
        .withColumn("missing", F.array_except(pairs, F.coalesce("offered", none)))
        .withColumn(
            "missing_items",
            F.filter(wanted, lambda r: F.exists("missing", lambda m: m["item"] == r)),
        )
        .withColumn("passed", F.size("missing") == 0)
        .drop("offered")
    )


def zone_gaps(
    requests: DataFrame, available: DataFrame, scope: Sequence[str], zones: str = "zones"
) -> DataFrame:
    """Requested zones that are not available in their scope, one row each."""
    keys = [*scope, "zone"]
    rest = [c for c in requests.columns if c != zones]
    asked = requests.select(*rest, F.explode(zones).alias("zone"))
    return hot_join(asked, available.select(*keys).distinct(), keys, "left_anti")


def common_zones(
    listing: DataFrame,
    required: Sequence[str],
    scope: Sequence[str],
    strict_missing: bool = False,
) -> DataFrame:
    """Zones of a scope where every required SKU that is listed at all can be had.

    Rows of one SKU apply in listing order: each adds its zones, then takes its restricted ones
    away, so the last row that names a zone decides. That is a maximum by position, found with
    partial aggregation instead of folding a collected list. ``strict_missing`` also asks that
    no required SKU is missing from the listing.
    """
    scope = list(scope)
    sku = [*scope, "name"]
    machines = listing.where(
        (F.col("resource_type") == "virtualMachines") & F.col("name").isin(*required)
    )
    added = F.flatten(
        F.transform("location_info", lambda i: F.coalesce(i["zones"], F.array().cast("array<string>")))
    )
    removed = F.flatten(
        F.transform(
            F.filter("restrictions", lambda r: r["type"] == "Zone"),
            lambda r: F.coalesce(r["zones"], F.array().cast("array<string>")),
        )
    )
    none = F.array().cast("array<string>")
    named = machines.select(
        *sku, "position", F.coalesce(added, none).alias("added"), F.coalesce(removed, none).alias("gone")
    )
    last_word = (
        named.select(*sku, "position", "gone", F.explode(F.array_union("added", "gone")).alias("zone"))
        .groupBy(*sku, "zone")
        .agg(F.max_by(~F.array_contains("gone", F.col("zone")), "position").alias("offered"))
    )
    seen = machines.select(*sku).distinct().groupBy(*scope).agg(F.count(F.lit(1)).alias("n_seen"))
    everywhere = (
        last_word.where("offered").groupBy(*scope, "zone").agg(F.count(F.lit(1)).alias("n_offering"))
    )
    common = everywhere.join(seen, scope).where(F.col("n_offering") == F.col("n_seen"))
    if strict_missing:
        common = common.where(F.col("n_seen") == len(set(required)))
    return common.select(*scope, "zone", "n_seen")


def nested_sku_search(
    listings: DataFrame,
    skus: str = "skus",
    edition: str = SERVER_EDITION,
    target: str = SERVER_SKU,
) -> DataFrame:
    """Adds ``verdict``: none (empty listing), restricted, present or absent, in that order."""
    listed = F.col(skus)
    restricted = F.contains(
        F.lower(F.coalesce(F.get(listed, F.lit(0))["reason"], F.lit(""))), F.lit("restricted")
    )
    present = F.exists(
        listed,
        lambda capability: F.exists(
            capability["supportedServerEditions"],
            lambda e: (e["name"] == edition)
            & F.exists(e["supportedServerSkus"], lambda sku: sku["name"] == target),
        ),
    )
    verdict = (
        F.when(F.coalesce(F.size(listed), F.lit(0)) <= 0, "none")
        .when(restricted, "restricted")
        .when(F.coalesce(present, F.lit(False)), "present")
        .otherwise("absent")
    )
    return listings.withColumn("verdict", verdict).withColumn(
        "passed", F.col("verdict") == "present"
    )


def preflight_rollup(
    results: DataFrame,
    deployments: DataFrame,
    orders: Mapping[str, Sequence[str]] = CHECK_ORDERS,
    deployment: str = "deployment",
    shape: str = "shape",
) -> DataFrame:
    """Per deployment: passed only if none of its results failed.

    ``failed`` lists the names of the failed checks in the order of the deployment's ``shape``;
    names that order does not have come last, by name. Nothing that failed is left out.
    """
    failures = (
        results.where(~F.col("passed")).groupBy(deployment).agg(F.collect_set("name").alias("failures"))
    )

    def ranked(places: Mapping[str, int]) -> Column:
        known = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
        place = lambda name: F.coalesce(known[name], F.lit(len(places)))
        pairs = F.transform("failures", lambda name: F.struct(place(name), name.alias("name")))
        return F.transform(F.array_sort(pairs), lambda pair: pair["name"])

    failed = F.array_sort("failures")
    for name, order in orders.items():
        places = {check: i for i, check in enumerate(order)}
        failed = F.when(F.col(shape) == name, ranked(places)).otherwise(failed)
    none = F.array().cast("array<string>")
    return (
        deployments.join(failures, deployment, "left")
        .withColumn("failed", F.coalesce(failed, none))
        .withColumn("n_failed", F.size("failed").cast("bigint"))
        .withColumn("passed", F.col("n_failed") == 0)
        .drop("failures")
    )


def zone_defaults(df: DataFrame, saved: str = "saved", available: str = "available") -> DataFrame:
    """Adds ``zones``: the saved answer if all its zones are available, else the first two."""
    answer = F.coalesce(F.col(saved), F.lit(""))
    usable = F.forall(F.split(answer, ","), lambda z: F.array_contains(F.col(available), F.trim(z)))
    first = F.concat_ws(",", F.slice(F.col(available), 1, ZONES_OFFERED))
    return df.withColumn("zones", F.when((answer != "") & usable, answer).otherwise(first))
