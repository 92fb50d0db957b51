"""Queries and checks for the address-space operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cidr as C
from ..operators import ranges as R
from .fixtures import dotted, fixture, oracle, size


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "range_wanted")
    return df.select(
        "range_id",
        "vpc_id",
        "is_public",
        "non_interactive",
        C.block(F.col("lo"), F.col("prefix")).alias("net"),
        F.sequence(F.lit(0), F.col("zones") - 1).alias("zones"),
    )


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "subnet_existing")
    return df.select(
        "subnet_id", "vpc_id", "zone", "is_ours", C.block(F.col("lo"), F.col("prefix")).alias("net")
    )


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "vpc_block")
    return df.select("vpc_id", "position", "state", C.block(F.col("lo"), F.col("prefix")).alias("net"))


def _networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "network_listing")
    return df.withColumn("prefixes", F.split("prefixes", ","))


def _edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "range_edge")
    return df.select("range_id", C.block(F.col("lo"), F.col("prefix")).alias("net"))


def _text(net: str):
    return C.format_cidr(F.col(net))


def range_policy_audit(spark, sf_dir):
    return R.range_policy_audit(fixture(spark, sf_dir, "range_text")).select("range_id", "verdict")


def range_policy_audit_prefix_only(spark, sf_dir):
    audited = R.range_policy_audit(
        fixture(spark, sf_dir, "range_text"), zones=None, min_prefix=0, private_only=False
    )
    return audited.select("range_id", "verdict")


def subnet_layout(spark, sf_dir):
    return R.subnet_layout(_wanted(spark, sf_dir)).select(
        "range_id", "zone", "kind", _text("subnet").alias("subnet")
    )


def range_overlap(spark, sf_dir):
    planned = R.subnet_layout(_wanted(spark, sf_dir)).select(
        "vpc_id", "range_id", F.col("zone").alias("zone_index"), "kind", "subnet", "net"
    )
    hits = R.range_overlap(planned, _existing(spark, sf_dir))
    return hits.select(
        "vpc_id",
        "range_id",
        F.col("zone_index").alias("zone"),
        "kind",
        _text("subnet").alias("subnet"),
        "subnet_id",
        _text("existing").alias("existing"),
    )


def range_overlap_free(spark, sf_dir):
    free = R.free_ranges(_wanted(spark, sf_dir), _existing(spark, sf_dir))
    return free.select("range_id", _text("net").alias("cidr"))


def _asked(spark, sf_dir):
    return _wanted(spark, sf_dir).withColumnRenamed("vpc_id", "account")


def fleet_range_conflicts(spark, sf_dir):
    out = R.fleet_range_conflicts(_asked(spark, sf_dir), _networks(spark, sf_dir))
    return out.select("range_id", "n_conflicts", "first_conflict", "passed")


def fleet_range_conflicts_derived(spark, sf_dir):
    asked = R.adjacent_range_derive(_asked(spark, sf_dir))
    out = R.fleet_range_conflicts(
        asked, _networks(spark, sf_dir), nets=("net", "db", "link")
    )
    return out.select("range_id", "n_conflicts", "first_conflict", "passed")


def fleet_range_conflict_pairs(spark, sf_dir):
    asked = _asked(spark, sf_dir).select("account", "range_id", "net")
    out = R.fleet_range_conflict_pairs(asked, _networks(spark, sf_dir))
    return out.select(
        "range_id", "network_id", _text("asked").alias("asked"), _text("listed").alias("listed")
    )


def reserved_range_conflicts(spark, sf_dir):
    out = R.reserved_range_conflicts(_edge(spark, sf_dir))
    return out.select("range_id", F.concat_ws(", ", "conflicts").alias("conflicts"), "passed")


def reserved_range_conflicts_service(spark, sf_dir):
    derived = R.adjacent_range_derive(_edge(spark, sf_dir))
    out = R.reserved_range_conflicts(
        derived, ("net", "db", "link"), R.RESERVED_SERVICE_BLOCKS
    )
    return out.select("range_id", F.concat_ws(", ", "conflicts").alias("conflicts"), "passed")


def range_placement_verdict(spark, sf_dir):
    out = R.range_placement_verdict(
        _wanted(spark, sf_dir), _blocks(spark, sf_dir), _existing(spark, sf_dir)
    )
    return out.select("range_id", "verdict", "passed")


def free_range_suggest(spark, sf_dir):
    out = R.free_range_suggest(_blocks(spark, sf_dir))
    return out.select("vpc_id", _text("suggested").alias("suggested"))


def adjacent_range_derive(spark, sf_dir):
    out = R.adjacent_range_derive(_edge(spark, sf_dir))
    return out.select("range_id", "verdict", _text("db").alias("db"), _text("link").alias("link"))


def range_collapse(spark, sf_dir):
    out = R.range_collapse(_existing(spark, sf_dir))
    return out.select("vpc_id", _text("net").alias("cidr"))


def layout_integrity_audit(spark, sf_dir):
    """The planned layout, with some subnets moved, doubled or lost by their request's id."""
    wanted = _wanted(spark, sf_dir)
    planned = R.subnet_layout(wanted).select("range_id", "zone", "kind", "subnet")
    lo, prefix = F.col("subnet.lo"), F.col("subnet.prefix")
    turn = F.col("range_id") % 7
    damaged = planned.withColumn(
        "subnet",
        F.when(turn == 0, C.block(lo + 65536 * 4, prefix))
        .when((turn == 1) & (F.col("kind") == "private"), C.block(C.truncate(lo, F.lit(18)), F.lit(18)))
        .otherwise(F.col("subnet")),
    ).withColumn("zone", F.when(turn == 2, F.lit(0)).otherwise(F.col("zone")))
    return R.layout_integrity_audit(wanted, damaged)


QUERIES = {
    f.__name__: f
    for f in (
        range_policy_audit,
        range_policy_audit_prefix_only,
        subnet_layout,
        range_overlap,
        range_overlap_free,
        fleet_range_conflicts,
        fleet_range_conflicts_derived,
        fleet_range_conflict_pairs,
        reserved_range_conflicts,
        reserved_range_conflicts_service,
        range_placement_verdict,
        free_range_suggest,
        adjacent_range_derive,
        range_collapse,
        layout_integrity_audit,
    )
}

# -- the same questions for DuckDB, by plain comparison of addresses ----------------------------

_READ = r"""
    select *, case when ok and lo % cast(power(2, 32 - prefix) as bigint) = 0 then lo end as net_lo
    from (select *, case when ok then try_cast(o[1] as bigint) * 16777216 + try_cast(o[2] as bigint) * 65536
                       + try_cast(o[3] as bigint) * 256 + try_cast(o[4] as bigint) end as lo
          from (select *, shaped and try_cast(o[1] as bigint) <= 255 and try_cast(o[2] as bigint) <= 255
                     and try_cast(o[3] as bigint) <= 255 and try_cast(o[4] as bigint) <= 255 and prefix <= 32 as ok
                from (select *, string_split(string_split(cidr, '/')[1], '.') as o,
                             try_cast(string_split(cidr, '/')[2] as bigint) as prefix,
                             regexp_full_match(cidr, '(0|[1-9][0-9]{0,2})([.](0|[1-9][0-9]{0,2})){3}/[0-9]{1,2}') as shaped
                      from range_text) a) b) c"""


def _in_private(lo, prefix):
    return " or ".join(
        f"({prefix} >= {p} and {lo} >= {b} and {lo} < {b + 2 ** (32 - p)})"
        for _, b, p in C.PRIVATE_BLOCKS
    )


_LAYOUT = f"""
    select range_id, vpc_id, zone, kind, non_interactive,
           lo + slot * {size('prefix + 4')} as slo,
           case when kind = 'private' then prefix + 2 when prefix = 16 then 20
                else greatest(26, prefix + 4) end as sp
    from (select w.*, z.zone, k.kind, case k.kind when 'public' then z.zone else 4 + 4 * z.zone end as slot
          from range_wanted w join (select unnest(range(0, 3)) as zone) z on z.zone < w.zones
          join (select unnest(['public', 'private']) as kind) k on k.kind = 'private' or w.is_public) t"""

_NETWORK = f"""
    select network_id, account, lo, prefix from (
      select network_id, account,
             cast(o[1] as bigint) * 16777216 + cast(o[2] as bigint) * 65536 + cast(o[3] as bigint) * 256
               + cast(o[4] as bigint) as lo, prefix
      from (select network_id, account, string_split(string_split(p, '/')[1], '.') as o,
                   cast(string_split(p, '/')[2] as int) as prefix
            from (select network_id, account, unnest(string_split(prefixes, ',')) as p
                  from network_listing) u where p <> 'none') v) x
    where lo % {size('prefix')} = 0"""


def _net(lo, prefix):
    return f"concat({dotted(lo)}, '/', cast({prefix} as string))"


def _hit(alo, ap, blo, bp):
    return f"{alo} < {blo} + {size(bp)} and {blo} < {alo} + {size(ap)}"


_ISLANDS = f"""
    islands as (
      select vpc_id, min(lo) as lo, max(hi) as hi from (
        select *, sum(starts) over (partition by vpc_id order by lo, hi, subnet_id) as island from (
          select *, case when lo <= max(hi) over (partition by vpc_id order by lo, hi, subnet_id
                     rows between unbounded preceding and 1 preceding) then 0 else 1 end as starts
          from (select vpc_id, subnet_id, lo, lo + {size('prefix')} as hi from subnet_existing) a) b) c
      group by vpc_id, island)"""

_DAMAGED = """
    select range_id, is_public, lo, prefix,
           case when range_id % 7 = 2 then 0 else zone end as zone,
           case when range_id % 7 = 0 then slo + 262144
                when range_id % 7 = 1 and kind = 'private' then slo - slo % 16384 else slo end as slo,
           case when range_id % 7 = 1 and kind = 'private' then 18 else sp end as sp,
           row_number() over (partition by range_id order by zone, kind) as nr
    from layout join range_wanted using (range_id)"""

ORACLES = {
    "range_policy_audit": oracle(
        f"""select range_id, case when net_lo is null then 'invalid'
                   when prefix not between 16 and 20 then 'prefix' when zones > 3 then 'zones'
                   when not ({_in_private('net_lo', 'prefix')}) then 'not_private' else 'ok' end as verdict
            from ({_READ}) r""",
        "range_text",
    ),
    "range_policy_audit_prefix_only": oracle(
        f"""select range_id, case when net_lo is null then 'invalid'
                   when prefix > 20 then 'prefix' else 'ok' end as verdict from ({_READ}) r""",
        "range_text",
    ),
    "subnet_layout": oracle(
        f"select range_id, cast(zone as int) as zone, kind, {_net('slo', 'sp')} as subnet from ({_LAYOUT}) l",
        "range_wanted",
    ),
    "range_overlap": oracle(
        f"""with layout as ({_LAYOUT})
            select l.vpc_id, range_id, cast(l.zone as int) as zone, kind, {_net('slo', 'sp')} as subnet,
                   subnet_id, cidr as existing
            from layout l join subnet_existing s on l.vpc_id = s.vpc_id and not is_ours
                 and {_hit('slo', 'sp', 's.lo', 's.prefix')}""",
        "range_wanted",
        "subnet_existing",
    ),
    "range_overlap_free": oracle(
        f"""with layout as ({_LAYOUT})
            select range_id, cidr from range_wanted where range_id not in (
              select range_id from layout l join subnet_existing s on l.vpc_id = s.vpc_id
                 and not is_ours and {_hit('slo', 'sp', 's.lo', 's.prefix')})""",
        "range_wanted",
        "subnet_existing",
    ),
    "fleet_range_conflicts": oracle(
        f"""with network as ({_NETWORK}),
            hit as (select range_id, count(*) as n, min({_net('n.lo', 'n.prefix')}) as first_conflict
                    from range_wanted w join network n on vpc_id = account
                         and {_hit('w.lo', 'w.prefix', 'n.lo', 'n.prefix')} group by range_id)
            select range_id, coalesce(n, 0) as n_conflicts, first_conflict,
                   coalesce(n, 0) = 0 or non_interactive as passed
            from range_wanted left join hit using (range_id)""",
        "range_wanted",
        "network_listing",
    ),
    "fleet_range_conflicts_derived": oracle(
        f"""with network as ({_NETWORK}),
            asked as (select range_id, vpc_id, lo, prefix from range_wanted
                      union all select range_id, vpc_id, lo + {size('prefix')}, prefix from range_wanted
                      union all select range_id, vpc_id, lo + 2 * {size('prefix')}, 27 from range_wanted),
            hit as (select range_id, count(*) as n, min({_net('n.lo', 'n.prefix')}) as first_conflict
                    from asked w join network n on vpc_id = account
                         and {_hit('w.lo', 'w.prefix', 'n.lo', 'n.prefix')} group by range_id)
            select range_id, coalesce(n, 0) as n_conflicts, first_conflict,
                   coalesce(n, 0) = 0 or non_interactive as passed
            from range_wanted left join hit using (range_id)""",
        "range_wanted",
        "network_listing",
    ),
    "fleet_range_conflict_pairs": oracle(
        f"""with network as ({_NETWORK})
            select range_id, network_id, cidr as asked, {_net('n.lo', 'n.prefix')} as listed
            from range_wanted w join network n on vpc_id = account
                 and {_hit('w.lo', 'w.prefix', 'n.lo', 'n.prefix')}""",
        "range_wanted",
        "network_listing",
    ),
    "reserved_range_conflicts": oracle(
        f"""select range_id, concat_ws(', ', case when {_hit('lo', 'prefix', 174326016, 24)} then '10.100.1.0/24' end,
                   case when {_hit('lo', 'prefix', 174326272, 24)} then '10.100.2.0/24' end) as conflicts,
                   not ({_hit('lo', 'prefix', 174326016, 24)}) and not ({_hit('lo', 'prefix', 174326272, 24)}) as passed
            from range_edge""",
        "range_edge",
    ),
    "reserved_range_conflicts_service": oracle(
        f"""with derived as (select range_id, lo, prefix, lo + 2 * {size('prefix')} < 4294967296 as fits from range_edge),
            judged as (select range_id, ({_hit('lo', 'prefix', 1879048192, 16)})
                 or (fits and ({_hit('lo + ' + size('prefix'), 'prefix', 1879048192, 16)}))
                 or (fits and ({_hit('lo + 2 * ' + size('prefix'), 27, 1879048192, 16)})) as hit from derived)
            select range_id, case when hit then '112.0.0.0/16' else '' end as conflicts, not hit as passed from judged""",
        "range_edge",
    ),
    "range_placement_verdict": oracle(
        f"""with layout as ({_LAYOUT}),
            carried as (select * from vpc_block where state = 'associated'),
            taken as (select distinct range_id from layout l join subnet_existing s on l.vpc_id = s.vpc_id
                      and not is_ours and {_hit('slo', 'sp', 's.lo', 's.prefix')}),
            against as (select range_id, bool_or(w.lo >= b.lo and w.prefix >= b.prefix) as held
                        from range_wanted w join carried b on w.vpc_id = b.vpc_id
                             and {_hit('w.lo', 'w.prefix', 'b.lo', 'b.prefix')} group by range_id),
            family as (select vpc_id, {", ".join(
                f"bool_or(prefix >= {p} and lo >= {b} and lo < {b + 2 ** (32 - p)}) as f{i}"
                for i, (_, b, p) in enumerate(C.PRIVATE_BLOCKS))} from carried group by vpc_id),
            judged as (select w.range_id, case when t.range_id is not null then 'taken'
                   when a.held then 'covered'
                   when (f0 or f1 or f2) and not ({" or ".join(
                       f"(f{i} and w.prefix >= {p} and w.lo >= {b} and w.lo < {b + 2 ** (32 - p)})"
                       for i, (_, b, p) in enumerate(C.PRIVATE_BLOCKS))}) then 'wrong_family'
                   when a.range_id is not null then 'partial_overlap' else 'free' end as verdict
            from range_wanted w left join taken t using (range_id) left join against a using (range_id)
                 left join family f on w.vpc_id = f.vpc_id)
            select range_id, verdict, verdict in ('covered', 'free') as passed from judged""",
        "range_wanted",
        "subnet_existing",
        "vpc_block",
    ),
    "free_range_suggest": oracle(
        f"""with slots as (select 0 as fam, 10 * 16777216 + unnest(range(0, 256)) * 65536 as slo
                       union all select 1, 2886729728 + unnest(range(0, 16)) * 65536
                       union all select 2, 3232235520),
            used as (select distinct vpc_id, case when prefix >= 8 and lo >= 167772160 and lo < 184549376 then 0
                       when prefix >= 12 and lo >= 2886729728 and lo < 2887778304 then 1
                       when prefix >= 16 and lo >= 3232235520 and lo < 3232301056 then 2 end as fam from vpc_block),
            free as (select u.vpc_id, u.fam, slo from used u join slots s on u.fam = s.fam
                     where not exists (select 1 from vpc_block b where b.vpc_id = u.vpc_id
                                       and {_hit('slo', 16, 'b.lo', 'b.prefix')})),
            pick as (select vpc_id, min((fam, slo)) as best from free group by vpc_id)
            select v.vpc_id, case when best is not null then {_net('best[2]', 16)} end as suggested
            from (select distinct vpc_id from vpc_block) v left join pick using (vpc_id)""",
        "vpc_block",
    ),
    "adjacent_range_derive": oracle(
        f"""with d as (select range_id, prefix, lo + {size('prefix')} as db, lo + 2 * {size('prefix')} as link from range_edge)
            select range_id, case when link >= 4294967296 then 'overflow' else 'ok' end as verdict,
                   case when link < 4294967296 then {_net('db', 'prefix')} end as db,
                   case when link < 4294967296 then {_net('link', 27)} end as link from d""",
        "range_edge",
    ),
    "range_collapse": oracle(
        f"""with {_ISLANDS},
            cut as (select vpc_id, lo, hi, p, unnest(range(cast(ceil(lo / power(2, 32 - p)) as bigint) * {size('p')},
                       hi - {size('p')} + 1, {size('p')})) as b
                    from islands, (select unnest(range(0, 33)) as p) ps)
            select vpc_id, {_net('b', 'p')} as cidr from cut
            where p = 0 or b - b % {size('p - 1')} < lo or b - b % {size('p - 1')} + {size('p - 1')} > hi""",
        "subnet_existing",
    ),
    "layout_integrity_audit": oracle(
        f"""with layout as ({_LAYOUT}), damaged as ({_DAMAGED}),
            outside as (select range_id, count(*) as n from damaged
                        where not (sp >= prefix and slo >= lo and slo < lo + {size('prefix')}) group by range_id),
            expected as (select range_id, z.zone, case when is_public then 2 else 1 end as n
                         from range_wanted w join (select unnest(range(0, 3)) as zone) z on z.zone < w.zones),
            found as (select range_id, zone, count(*) as n from damaged group by range_id, zone),
            wrong as (select range_id, count(*) as n from expected e full join found f using (range_id, zone)
                      where e.n is distinct from f.n group by range_id),
            pairs as (select a.range_id, count(*) as n from damaged a join damaged b on a.range_id = b.range_id
                      and a.nr < b.nr and {_hit('a.slo', 'a.sp', 'b.slo', 'b.sp')} group by a.range_id)
            select range_id, coalesce(o.n, 0) as n_outside, coalesce(x.n, 0) as n_wrong_zones,
                   coalesce(p.n, 0) as n_overlap_pairs,
                   coalesce(o.n, 0) + coalesce(x.n, 0) + coalesce(p.n, 0) = 0 as passed
            from range_wanted left join outside o using (range_id) left join wrong x using (range_id)
                 left join pairs p using (range_id)""",
        "range_wanted",
    ),
}
