"""Queries and checks for the permission, ownership and exposure audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..session import scratch
from ..sources import exports as E
from .fixtures import fixture, oracle


def permission_verdicts(spark, sf_dir):
    return A.permission_verdicts(
        fixture(spark, sf_dir, "probe_answer"), fixture(spark, sf_dir, "deployment")
    )


def permission_rollup(spark, sf_dir):
    return A.permission_rollup(permission_verdicts(spark, sf_dir))


def foreign_account_guard(spark, sf_dir):
    return A.foreign_account_guard(
        fixture(spark, sf_dir, "state_resource"), fixture(spark, sf_dir, "caller")
    )


def _landed(spark, sf_dir):
    """The resources as exports of whole stacks, landed once and read back."""
    outputs = F.struct(F.col("vpc_id").alias("vpcId"), F.col("outputs").alias("raw"))
    resource = F.struct("type", "urn", outputs.alias("outputs"))
    stacks = fixture(spark, sf_dir, "state_resource").groupBy("stack").agg(F.collect_list(resource).alias("resources"))
    exports = stacks.select("stack", F.to_json(F.struct(F.struct("resources").alias("deployment"))).alias("export"))
    path = scratch(spark, "state-exports")
    E.land_exports(exports, path)
    return spark.read.parquet(path)


def foreign_account_guard_landed(spark, sf_dir):
    return A.account_guard(E.landed_accounts(_landed(spark, sf_dir)), fixture(spark, sf_dir, "caller"))


def resource_shape_audit_landed(spark, sf_dir):
    resources = E.landed_resources(_landed(spark, sf_dir), "bigint")
    return A.resource_shape_audit(resources, fixture(spark, sf_dir, "stack"))


def exposure_audit(spark, sf_dir):
    return A.exposure_audit(
        fixture(spark, sf_dir, "deployment"),
        fixture(spark, sf_dir, "balancer"),
        fixture(spark, sf_dir, "ingress"),
    )


def resource_shape_audit(spark, sf_dir):
    return A.resource_shape_audit(
        fixture(spark, sf_dir, "state_resource"), fixture(spark, sf_dir, "stack")
    )


def leftover_stacks(spark, sf_dir):
    return A.leftover_stacks(
        fixture(spark, sf_dir, "stack_listing"), fixture(spark, sf_dir, "stack_gone")
    )


def baseline_new_keys(spark, sf_dir):
    clusters = fixture(spark, sf_dir, "cluster_listing")
    baseline = clusters.where(F.col("status") != "O")
    return A.baseline_new_keys(fixture(spark, sf_dir, "cluster_request"), clusters, baseline)


QUERIES = {
    f.__name__: f
    for f in (
        permission_verdicts,
        permission_rollup,
        foreign_account_guard,
        foreign_account_guard_landed,
        exposure_audit,
        resource_shape_audit,
        resource_shape_audit_landed,
        leftover_stacks,
        baseline_new_keys,
    )
}

_VERDICTS = """
    verdicts as (select p.deployment, action, table_id,
             case max(case error_code when 'UnauthorizedOperation' then 2 when 'DryRunOperation' then 1 else 0 end)
                  when 2 then 'refused' when 1 then 'allowed' else 'unknown' end as verdict
      from probe_answer p join deployment d using (deployment)
      where action <> 'ec2:CreateRouteTable' or is_public group by p.deployment, action, table_id)"""

_COUNTS = {
    A.VPC: "case shape when 'own' then 1 else 0 end",
    A.CIDR_ASSOCIATION: "case shape when 'own' then 0 else 1 end",
    A.SUBNET: "case shape when 'private' then n_zones else 2 * n_zones end",
    A.NAT: "case shape when 'own' then n_zones else 0 end",
    A.ROUTE_TABLE: "case shape when 'own' then 1 + n_zones when 'private' then 0 else 1 end",
}
_CHECKS = [(name, want, f"type = '{name}'") for name, want in _COUNTS.items()]
_CHECKS += [(f"stray {p}", "0", f"starts_with(type, '{p}')") for p in A.STRAY_PREFIXES]
_CHECKS += [
    ("forbidden name", "0", " or ".join(f"ends_with(urn, '{s}')" for s in A.FORBIDDEN_SUFFIXES)),
    ("foreign network", "0", f"type = '{A.SUBNET}' and vpc_id <> expected_vpc_id"),
]

ORACLES = {
    "permission_verdicts": oracle(
        f"with {_VERDICTS} select * from verdicts", "probe_answer", "deployment"
    ),
    "permission_rollup": oracle(
        f"""with {_VERDICTS} select deployment, count(*) filter (verdict = 'refused') as n_refused,
            count(*) filter (verdict = 'unknown') as n_unknown, not bool_or(verdict = 'refused') as passed
            from verdicts group by deployment""",
        "probe_answer",
        "deployment",
    ),
    "foreign_account_guard": oracle(
        """with ids as (select distinct stack, unnest(regexp_extract_all(outputs, 'arn:aws:[a-z0-9-]*:[a-z0-9-]*:([0-9]{12}):', 1)) as account
                        from state_resource),
           n as (select stack, count(*) as n, min(account) as first_account, list(account) as ids from ids group by stack)
           select stack, caller, coalesce(n, 0) as n_accounts, first_account,
                  coalesce(not list_contains(ids, caller), false) as violation
           from caller left join n using (stack)""",
        "state_resource",
        "caller",
    ),
    "exposure_audit": oracle(
        """with f as (select vpc_id, count(*) as n from balancer where scheme = 'internet-facing' group by vpc_id),
           i as (select deployment, count(*) filter (name in ('gloo-lb', 'gloo-lb-http1')) as n,
                        bool_or(name = 'private-gloo-lb') as p from ingress where namespace = 'gloo-system' group by deployment)
           select deployment, coalesce(f.n, 0) as n_facing, coalesce(i.n, 0) as n_public_ingresses,
                  coalesce(p, false) as has_private_ingress,
                  f.n is null and coalesce(i.n, 0) = 0 and coalesce(p, false) as passed
           from deployment left join f using (vpc_id) left join i using (deployment) where not is_public""",
        "deployment",
        "balancer",
        "ingress",
    ),
    "resource_shape_audit": oracle(
        "with r as (select s.stack, shape, n_zones, expected_vpc_id, type, urn, vpc_id from stack s "
        "left join state_resource using (stack)), c as ("
        + " union all ".join(
            f"select stack, '{name}' as \"check\", any_value({want}) as expected, count(*) filter ({test}) as found from r group by stack"
            for name, want, test in _CHECKS
        )
        + ') select stack, "check", cast(expected as bigint) as expected, found, expected = found as passed from c',
        "state_resource",
        "stack",
    ),
    "leftover_stacks": oracle(
        """with l as (select qualified, string_split(qualified, '/')[-1] as name from stack_listing)
           select qualified, name, case when '-' || name || '-' like '%-aws-%' then 'aws' when '-' || name || '-' like '%-gcp-%' then 'gcp'
                  when '-' || name || '-' like '%-azure-%' then 'azure' else 'aws' end as cloud
           from l where name in (select name from stack_gone)""",
        "stack_listing",
        "stack_gone",
    ),
    "baseline_new_keys": oracle(
        """with pick as (select r.*, case when r.vpc_id is not null then
                    (select min(name) from cluster_listing c where c.region = r.region and c.vpc_id = r.vpc_id)
                  when has_baseline then (select min(name) from cluster_listing c where c.region = r.region and status = 'O') end as cluster
                  from cluster_request r)
           select request_id, cluster, case when vpc_id is null and not has_baseline then 'refused'
                  when cluster is null then 'none' else 'found' end as status from pick""",
        "cluster_listing",
        "cluster_request",
    ),
}

ORACLES |= {f"{name}_landed": ORACLES[name] for name in ("foreign_account_guard", "resource_shape_audit")}
