"""Permission, ownership and exposure audits: semi and anti joins, conditional counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import hot_join

# fixed values: probe answers, account ids in resource names, ingress names, resource types
REFUSED_CODE = "UnauthorizedOperation"
ALLOWED_CODE = "DryRunOperation"
ROUTE_TABLE_PROBE = "ec2:CreateRouteTable"
ACCOUNT_IN_ARN = r"arn:aws:[a-z0-9-]*:[a-z0-9-]*:(\d{12}):"
PUBLIC_INGRESSES = ("gloo-lb", "gloo-lb-http1")
PRIVATE_INGRESS = "private-gloo-lb"
INGRESS_NAMESPACE = "gloo-system"
INTERNET_FACING = "internet-facing"
VPC = "aws:ec2/vpc:Vpc"
SUBNET = "aws:ec2/subnet:Subnet"
NAT = "aws:ec2/natGateway:NatGateway"
CIDR_ASSOCIATION = "aws:ec2/vpcIpv4CidrBlockAssociation:VpcIpv4CidrBlockAssociation"
ROUTE_TABLE = "aws:ec2/routeTable:RouteTable"
STRAY_PREFIXES = ("aws:eks", "aws:rds", "kubernetes:")
FORBIDDEN_SUFFIXES = (
    "::pc-environment",
    "::pc-cpgw-api-key",
    "::pc-service-account",
    "::pc-api-key",
    "::pc-datadog-api-key",
)
CLOUDS = ("aws", "gcp", "azure")


def permission_verdicts(
    answers: DataFrame, deployments: DataFrame, deployment: str = "deployment"
) -> DataFrame:
    """One row per distinct probe (action, and table where one is named) with its verdict.

    Only a refusal is refused; a dry run that would have worked, or no error, is allowed; any
    other code is unknown. The route-table probe counts only with public access. A probe asked
    twice is refused if any answer refuses it, allowed if any allows it.
    """
    refused = F.bool_or(F.col("error_code").eqNullSafe(REFUSED_CODE))
    allowed = F.bool_or(F.col("error_code").isNull() | (F.col("error_code") == ALLOWED_CODE))
    per_probe = answers.groupBy(deployment, "action", "table_id").agg(
        F.when(refused, "refused").when(allowed, "allowed").otherwise("unknown").alias("verdict")
    )
    asked = hot_join(per_probe, deployments.select(deployment, "is_public"), [deployment])
    return asked.where(F.col("is_public") | (F.col("action") != ROUTE_TABLE_PROBE)).drop("is_public")


def permission_rollup(verdicts: DataFrame, deployment: str = "deployment") -> DataFrame:
    """Per deployment: number of refusals; passed unless something is refused."""
    n_refused = F.count_if(F.col("verdict") == "refused")
    return (
        verdicts.groupBy(deployment)
        .agg(n_refused.alias("n_refused"), F.count_if(F.col("verdict") == "unknown").alias("n_unknown"))
        .withColumn("passed", F.col("n_refused") == 0)
    )


def stack_accounts(state: DataFrame, stack: str = "stack", text: str = "outputs") -> DataFrame:
    """The distinct account ids in the resource names of each stack's state, one row each."""
    ids = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(ACCOUNT_IN_ARN), F.lit(1)))
    return state.select(stack, F.explode(ids).alias("account")).distinct()


def foreign_account_guard(
    state: DataFrame, callers: DataFrame, stack: str = "stack", text: str = "outputs"
) -> DataFrame:
    """Per stack to be changed: a violation if its state names accounts, but not the caller's."""
    return account_guard(stack_accounts(state, stack, text), callers, stack)


def account_guard(accounts: DataFrame, callers: DataFrame, stack: str = "stack") -> DataFrame:
    """`foreign_account_guard` for accounts that are already known, one row per stack and account.

    Accounts are exploded, so they are more than the planner takes them for: merged, not broadcast.
    """
    named = accounts.hint("merge").join(callers, stack)
    owned = named.groupBy(stack).agg(
        F.count(F.lit(1)).alias("n_accounts"),
        F.min("account").alias("first_account"),
        F.bool_or(F.col("account") == F.col("caller")).alias("is_owner"),
    )
    return (
        callers.hint("merge")
        .join(owned, stack, "left")
        .withColumn("n_accounts", F.coalesce("n_accounts", F.lit(0).cast("bigint")))
        .withColumn("violation", (F.col("n_accounts") > 0) & ~F.col("is_owner"))
        .drop("is_owner")
    )


def exposure_audit(
    deployments: DataFrame,
    balancers: DataFrame,
    ingresses: DataFrame,
    deployment: str = "deployment",
    vpc: str = "vpc_id",
) -> DataFrame:
    """Private deployments with counts of what faces the internet, and whether they pass."""
    private = deployments.where(~F.col("is_public"))
    facing = (
        balancers.where(F.col("scheme") == INTERNET_FACING)
        .groupBy(vpc)
        .agg(F.count(F.lit(1)).alias("n_facing"))
    )
    ours = ingresses.where(F.col("namespace") == INGRESS_NAMESPACE)
    per_deployment = ours.groupBy(deployment).agg(
        F.count_if(F.col("name").isin(*PUBLIC_INGRESSES)).alias("n_public"),
        F.bool_or(F.col("name") == PRIVATE_INGRESS).alias("has_private"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        hot_join(private, facing, [vpc], "left")
        .join(per_deployment, deployment, "left")
        .select(
            deployment,
            F.coalesce("n_facing", zero).alias("n_facing"),
            F.coalesce("n_public", zero).alias("n_public_ingresses"),
            F.coalesce("has_private", F.lit(False)).alias("has_private_ingress"),
        )
        .withColumn(
            "passed",
            (F.col("n_facing") == 0) & (F.col("n_public_ingresses") == 0) & F.col("has_private_ingress"),
        )
    )


def expected_counts(shape: Column, zones: Column) -> dict[str, Column]:
    """How many of each network resource a shape (own, existing, private) owns."""
    own, private = shape == "own", shape == "private"
    zero, one = F.lit(0), F.lit(1)
    return {
        VPC: F.when(own, one).otherwise(zero),
        CIDR_ASSOCIATION: F.when(own, zero).otherwise(one),
        SUBNET: F.when(private, zones).otherwise(2 * zones),
        NAT: F.when(own, zones).otherwise(zero),
        ROUTE_TABLE: F.when(own, 1 + zones).when(private, zero).otherwise(one),
    }


def resource_shape_audit(
    resources: DataFrame, stacks: DataFrame, stack: str = "stack"
) -> DataFrame:
    """Per stack and check: expected and found counts, and whether they agree.

    Checks: each network resource type, each stray type prefix, forbidden names, and subnets
    outside the stack's network. All counts of a stack come from one aggregation; the fixed list
    of checks is turned into rows after it. Resources read out of exports are exploded, so they are more
    than the planner takes them for: both joins merge, and nothing is gathered on the driver.
    """
    kind, urn = F.col("type"), F.col("urn")
    expected = {
        name: column.cast("bigint")
        for name, column in expected_counts(F.col("shape"), F.col("n_zones")).items()
    }
    found = {name: kind == name for name in expected}
    for prefix in STRAY_PREFIXES:
        found[f"stray {prefix}"] = F.startswith(kind, F.lit(prefix))
    ends = [F.endswith(urn, F.lit(suffix)) for suffix in FORBIDDEN_SUFFIXES]
    found["forbidden name"] = F.greatest(*ends)
    found["foreign network"] = (kind == SUBNET) & F.col("vpc_id").isNotNull()
    names = list(found)
    # counted in the map tasks per stack and network; only then is a stack's own network looked up
    by_network = resources.groupBy(stack, "vpc_id").agg(
        *[F.count_if(F.coalesce(test, F.lit(False))).alias(f"c{i}") for i, test in enumerate(found.values())]
    )
    foreign = f"c{names.index('foreign network')}"
    with_stack = by_network.hint("merge").join(stacks.select(stack, "expected_vpc_id"), stack).withColumn(
        foreign, F.when(F.col("vpc_id") != F.col("expected_vpc_id"), F.col(foreign)).otherwise(0)
    )
    counted = with_stack.groupBy(stack).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(names))])
    zero = F.lit(0).cast("bigint")
    checks = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                expected.get(name, zero).alias("expected"),
                F.coalesce(F.col(f"c{i}"), zero).alias("found"),
            )
            for i, name in enumerate(names)
        ]
    )
    return (
        stacks.hint("merge")
        .join(counted, stack, "left")
        .select(stack, F.inline(checks))
        .withColumn("passed", F.col("expected") == F.col("found"))
    )


def stack_leaf(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def cloud_of(name: Column, override: Column | None = None) -> Column:
    """The cloud a stack's name says it is in; the first of the list when it says none."""
    padded = F.concat(F.lit("-"), name, F.lit("-"))
    named = F.coalesce(
        *[F.when(F.contains(padded, F.lit(f"-{c}-")), F.lit(c)) for c in CLOUDS], F.lit(CLOUDS[0])
    )
    return named if override is None else F.coalesce(F.nullif(override, F.lit("")), named)


def leftover_stacks(stacks: DataFrame, gone: DataFrame) -> DataFrame:
    """Stacks (``org/project/name``) still listed whose name should be gone, with their cloud."""
    listed = stacks.withColumn("name", stack_leaf(F.col("qualified")))
    return hot_join(listed, gone.select("name").distinct(), ["name"], "left_semi").withColumn(
        "cloud", cloud_of(F.col("name"))
    )


def baseline_new_keys(
    requests: DataFrame,
    clusters: DataFrame,
    baseline: DataFrame,
    scope: Sequence[str] = ("region",),
    request_id: str = "request_id",
) -> DataFrame:
    """Per request: the first cluster by name that is its own.

    With a ``vpc_id`` that is the first in that network; else the first not in the region's
    baseline. A request with neither a network nor a baseline (``has_baseline``) is refused.
    The minima are found before the join, so no request meets a region's clusters one by one.
    """
    scope = list(scope)
    by_vpc = clusters.groupBy(*scope, "vpc_id").agg(F.min("name").alias("in_vpc"))
    fresh = (
        clusters.join(baseline.select(*scope, "name"), [*scope, "name"], "left_anti")
        .groupBy(*scope)
        .agg(F.min("name").alias("fresh"))
    )
    refused = F.col("vpc_id").isNull() & ~F.col("has_baseline")
    found = F.when(F.col("vpc_id").isNotNull(), F.col("in_vpc")).when(
        F.col("has_baseline"), F.col("fresh")
    )
    joined = hot_join(
        hot_join(requests, by_vpc, [*scope, "vpc_id"], "left"), fresh, scope, "left"
    )
    return joined.select(
        request_id,
        found.alias("cluster"),
        F.when(refused, "refused").when(found.isNull(), "none").otherwise("found").alias("status"),
    )
