"""Queries and checks for the routing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import egress as E
from .fixtures import fixture, oracle

ORDER = ("position", "tie")


def _routes(spark, sf_dir):
    return fixture(spark, sf_dir, "route")


def _parts(spark, sf_dir):
    subnets = fixture(spark, sf_dir, "egress_subnet")
    return fixture(spark, sf_dir, "egress_zone"), subnets, fixture(spark, sf_dir, "association")


def route_target(spark, sf_dir):
    return E.route_target(_routes(spark, sf_dir)).select("table_id", "position", "tie", "target")


def table_egress_live(spark, sf_dir):
    return E.table_egress(_routes(spark, sf_dir), "live", ORDER)


def table_egress_declared(spark, sf_dir):
    return E.table_egress(_routes(spark, sf_dir), "declared", ORDER)


def zone_egress_live(spark, sf_dir):
    return E.zone_egress(*_parts(spark, sf_dir), table_egress_live(spark, sf_dir), "live")


def zone_egress_declared(spark, sf_dir):
    return E.zone_egress(*_parts(spark, sf_dir), table_egress_declared(spark, sf_dir), "declared")


def egress_verdict(spark, sf_dir):
    return E.egress_verdict(zone_egress_live(spark, sf_dir))


def associable_tables(spark, sf_dir):
    return E.associable_tables(*_parts(spark, sf_dir), table_egress_live(spark, sf_dir))


def zone_egress_candidates(spark, sf_dir):
    return E.zone_egress_candidates(*_parts(spark, sf_dir), _routes(spark, sf_dir), ORDER)


def override_merge(spark, sf_dir):
    zones, subnets, associations = _parts(spark, sf_dir)
    unnamed = zones.where(F.col("named").isNull())
    egress = table_egress_declared(spark, sf_dir)
    found = E.zone_egress(unnamed, subnets, associations, egress, "declared")
    detected = found.where(F.col("status") == "egressing").select("vpc_id", "zone", "table_id")
    named = zones.where(F.col("named").isNotNull()).select(
        "vpc_id", "zone", F.col("named").alias("table_id")
    )
    deployed = zones.where(F.col("zone") < 2)
    return E.override_merge(detected, named, deployed, egress)


QUERIES = {
    f.__name__: f
    for f in (
        route_target,
        table_egress_live,
        table_egress_declared,
        zone_egress_live,
        zone_egress_declared,
        egress_verdict,
        associable_tables,
        zone_egress_candidates,
        override_merge,
    )
}

_TARGET = """case when destination = '0.0.0.0/0' then case when nat_gateway_id is not null then nat_gateway_id
    when transit_gateway_id <> '' then transit_gateway_id when gateway_id like 'vgw-%' then gateway_id end end"""
_DEFAULTS = f"""
    d as (select table_id, state, gateway_id, peering_id, {_TARGET} as target,
                 row_number() over (partition by table_id order by position, tie) as nr
          from route where destination = '0.0.0.0/0')"""
_LIVE = f"""{_DEFAULTS},
    egress as (select table_id, target from d where state = 'active' and target is not null
               qualify row_number() over (partition by table_id order by nr) = 1)"""
_DECLARED = f"""{_DEFAULTS},
    egress as (select table_id, target from d where nr = 1 and target is not null)"""
_TABLES = """
    main as (select distinct vpc_id, table_id from association where main),
    zt as (select distinct s.vpc_id, s.zone, a.table_id from egress_subnet s join association a using (subnet_id)),
    own as (select vpc_id, zone, count(*) as n, min(table_id) as t, min_by(target, table_id) as x,
                   bool_or(table_id in (select table_id from main)) as m
            from zt join egress using (table_id) group by vpc_id, zone),
    inh as (select vpc_id, min(table_id) as it, min_by(target, table_id) as ix from main join egress using (table_id) group by vpc_id)"""
_ZONE_LIVE = f"""{_LIVE}, {_TABLES},
    zone_live as (select z.vpc_id, z.zone,
        case when named is not null then case when e.target is not null then 'egressing' else 'silent' end
             when n > 1 then 'ambiguous' when n = 1 then 'egressing' when it is not null then 'inherited_main' else 'silent' end as status,
        case when named is not null then 1 else coalesce(n, 0) end as n_tables,
        case when named is not null then named else coalesce(t, it) end as table_id,
        case when named is not null then e.target else coalesce(x, ix) end as target
      from egress_zone z left join own using (vpc_id, zone) left join inh using (vpc_id) left join egress e on named = e.table_id)"""
_ZONE_DECLARED = f"""{_DECLARED}, {_TABLES},
    zone_declared as (select z.vpc_id, z.zone,
        case when named is not null then case when e.target is not null then 'egressing' else 'silent' end
             when n > 1 then 'ambiguous' when n = 1 and not m then 'egressing' else 'inherited_main' end as status,
        case when named is not null then 1 else coalesce(n, 0) end as n_tables,
        case when named is not null then named else t end as table_id,
        case when named is not null then e.target else x end as target, named
      from egress_zone z left join own using (vpc_id, zone) left join egress e on named = e.table_id)"""
_ZONE_SOURCES = ("route", "association", "egress_subnet", "egress_zone")

ORACLES = {
    "route_target": oracle(f"select table_id, position, tie, {_TARGET} as target from route", "route"),
    "table_egress_live": oracle(f"with {_LIVE} select * from egress", "route"),
    "table_egress_declared": oracle(f"with {_DECLARED} select * from egress", "route"),
    "zone_egress_live": oracle(f"with {_ZONE_LIVE} select * from zone_live", *_ZONE_SOURCES),
    "zone_egress_declared": oracle(
        f"with {_ZONE_DECLARED} select vpc_id, zone, status, n_tables, table_id, target from zone_declared",
        *_ZONE_SOURCES,
    ),
    "egress_verdict": oracle(
        f"""with {_ZONE_LIVE}, v as (select vpc_id, count(*) filter (status = 'ambiguous') as n_ambiguous,
              count(*) filter (status = 'silent') as n_silent from zone_live group by vpc_id)
            select *, case when n_ambiguous > 0 then 'ambiguous' when n_silent > 0 then 'silent' else 'ok' end as verdict,
                   n_ambiguous + n_silent = 0 as passed from v""",
        *_ZONE_SOURCES,
    ),
    "associable_tables": oracle(
        f"""with {_LIVE}, {_TABLES}, sole as (select vpc_id, zone, min(table_id) as t from zt
              where table_id in (select table_id from egress) and table_id not in (select table_id from main)
              group by vpc_id, zone having count(*) = 1)
            select vpc_id, zone, coalesce(named, t) as table_id, named is not null as is_named
            from egress_zone left join sole using (vpc_id, zone) where coalesce(named, t) is not null""",
        *_ZONE_SOURCES,
    ),
    "zone_egress_candidates": oracle(
        f"""with {_LIVE}, {_TABLES},
            c as (select table_id, coalesce(target, gateway_id, peering_id) as target, target is not null as usable from d
                  where state = 'active' and coalesce(target, gateway_id, peering_id) is not null
                  qualify row_number() over (partition by table_id order by nr) = 1),
            seen as (select z.vpc_id, z.zone, table_id, c.target, usable, false as inherited
                     from egress_zone z join zt using (vpc_id, zone) join c using (table_id))
            select * from seen union all
            select z.vpc_id, z.zone, m.table_id, c.target, true, true from egress_zone z join main m using (vpc_id)
              join c on c.table_id = m.table_id and usable
            where not exists (select 1 from seen s where s.vpc_id = z.vpc_id and s.zone = z.zone and s.usable)""",
        *_ZONE_SOURCES,
    ),
    "override_merge": oracle(
        f"""with {_ZONE_DECLARED}
            select vpc_id, zone, coalesce(named, table_id) as table_id,
                   case when named is not null then 'named' else 'detected' end as source,
                   case when named is not null and zone >= 2 then 'rejected'
                        when named is not null and target is null then 'warning' else 'ok' end as status
            from zone_declared where named is not null or status = 'egressing'""",
        *_ZONE_SOURCES,
    ),
}
