"""Queries and checks for snapshot maintenance and naming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import naming as N
from ..operators import snapshots as S
from ..session import scratch
from ..sources import versions as V
from .fixtures import fixture, oracle

FIELDS = {
    "environment": ("env_name", "cloud", "region", "is_public_endpoint_enabled"),
    "api_key": ("value", "project_name", "key_name", "org_id"),
    "dns_delegation": ("unused", "subdomain", "nameservers", "zone"),
    "metrics_key": ("api_key", "name", "key_id", "org_id"),
    "uninstaller": ("unused", "image", "kubeconfig", "note"),
    "service_account": ("client_id", "name", "client_secret", "note"),
    "metrics_access": ("amp_region", "workload_role_arn", "amp_remote_write_endpoint", "note"),
    "gateway_key": ("key", "environment", "key_id", "note"),
}
SETTINGS = ("api_url", "cidr", "domain", "env", "key", "region", "zones")
AS_OF = "2001-11-04"


def _records(spark, sf_dir, name):
    """Property bags from four generic columns, named by the record's kind; nulls are absent."""
    bags = F.create_map().cast("map<string,string>")
    for kind, names in FIELDS.items():
        bag = F.create_map(*[x for f, c in zip(names, "abcd", strict=True) for x in (F.lit(f), F.col(c))])
        bags = F.when(F.col("kind") == kind, bag).otherwise(bags)
    df = fixture(spark, sf_dir, name)
    return df.select("id", "kind", F.map_filter(bags, lambda k, v: v.isNotNull()).alias("props"))


def state_diff(spark, sf_dir):
    out = S.state_diff(_records(spark, sf_dir, "record_old"), _records(spark, sf_dir, "record_new"))
    return out.select("id", "kind", "action", F.concat_ws(",", "replaces").alias("replaces"))


def stable_carry_forward(spark, sf_dir):
    out = S.stable_carry_forward(
        _records(spark, sf_dir, "record_old"), _records(spark, sf_dir, "record_new")
    )
    props = F.array_sort(F.map_entries("props"))
    return out.select(
        "id",
        F.concat_ws(";", F.transform(props, lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("props"),
    )


def _text_of(tags):
    entries = F.array_sort(F.map_entries(tags))
    return F.concat_ws(",", F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def tag_merge(spark, sf_dir):
    df = fixture(spark, sf_dir, "tagged")
    base = S.base_tags(
        F.col("cloud"),
        F.col("env"),
        {"aws": "x:managed-by", "gcp": "x-managed-by", "azure": "x-managed-by"},
        "tool",
        {"aws": (("partner", "live"), ("test-partner", "other"))},
    )
    custom = F.when(F.col("owner").isNotNull(), F.create_map(F.lit("owner"), F.col("owner")))
    extra = F.create_map(F.lit("Name"), F.col("name"), F.lit("partner"), F.lit("mine"))
    parts = df.select("id", base.alias("base"), custom.alias("custom"), F.when(F.col("has_extra"), extra).alias("extra"))
    return S.tag_merge(parts, "base", "custom", "extra").select("id", _text_of("tags").alias("tags"))


LAYERS = ("env", "saved", "default")


def layered_config(spark, sf_dir):
    return S.layered_config(fixture(spark, sf_dir, "setting"), LAYERS, ["scope"], tie=["value"])


def layered_config_json(spark, sf_dir):
    return S.layered_config_json(
        layered_config(spark, sf_dir), SETTINGS, ["scope"], {"region": "here", "env": "prod"}
    )


def keyvalue_flatten_tags(spark, sf_dir):
    out = S.keyvalue_flatten(fixture(spark, sf_dir, "keyvalue").select("id", "tags"), "tags", "tags")
    return out.select("id", "key", "value")


def keyvalue_flatten_zone_tables(spark, sf_dir):
    df = fixture(spark, sf_dir, "keyvalue").select("id", "zone_tables")
    return S.keyvalue_flatten(df, "zone_tables", "zone_tables")


def keyvalue_flatten_exports(spark, sf_dir):
    df = fixture(spark, sf_dir, "keyvalue").select("id", "exports")
    return S.keyvalue_flatten(df, "exports", "exports").select("id", "key", "value", "ok")


def _sweep(spark, sf_dir, rules):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    out = S.retention_sweep(fixture(spark, sf_dir, "object"), rules, as_of)
    return out.groupBy("object_key", "rule", F.date_format("due", "yyyy-MM-dd").alias("due")).agg(
        F.count(F.lit(1)).alias("n")
    )


def retention_sweep_aws(spark, sf_dir):
    return _sweep(spark, sf_dir, S.aws_rules())


def retention_sweep_gcp(spark, sf_dir):
    return _sweep(spark, sf_dir, S.gcp_rules())


def retention_sweep_azure(spark, sf_dir):
    return _sweep(spark, sf_dir, S.azure_rules())


def retention_sweep_rules(spark, sf_dir):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    objects, rules = fixture(spark, sf_dir, "object_listed"), fixture(spark, sf_dir, "retention_rule")
    out = S.retention_sweep_by_rules(objects, rules, as_of)
    return out.groupBy("account", "object_key", "rule", F.date_format("due", "yyyy-MM-dd").alias("due")).agg(
        F.count(F.lit(1)).alias("n")
    )


def snapshot_merge(spark, sf_dir):
    """Two snapshots kept in one table of versions, the second landed twice as a retried job would."""
    path = scratch(spark, "snapshot-merge")
    for name, snapshot in (("record_old", "first"), ("record_new", "second"), ("record_new", "second")):
        V.upsert_snapshot(fixture(spark, sf_dir, name), path, ["id"], snapshot, buckets=16)
    return V.read_snapshot(spark, path)


def name_collision_audit(spark, sf_dir):
    df = fixture(spark, sf_dir, "tenant").withColumn(
        "cell", N.cell_name(F.col("organisation"), F.col("environment"))
    )
    cell = F.col("cell")
    names = {
        "cell": (cell, 63),
        "storage": (N.storage_account_name(F.lit("pcdata"), cell), N.STORAGE_LIMIT),
        "vault": (N.key_vault_name(F.lit("kv"), cell), N.VAULT_LIMIT),
        "account": (N.service_account_name(F.lit("writer"), cell), N.SERVICE_ACCOUNT_LIMIT),
        "bucket": (N.bucket_name(F.lit("internal"), cell), N.BUCKET_LIMIT),
        "balancer": (N.balancer_name(F.col("environment"), private=True), N.BALANCER_LIMIT),
        "pool": (N.pool_name(F.col("pool")), N.POOL_LIMIT),
    }
    out = N.name_collision_audit(df, names, ["id"])
    return out.select(
        "kind",
        "name",
        "n_owners",
        F.col("first_owner.id").alias("first_owner"),
        F.col("last_owner.id").alias("last_owner"),
        "n_chars",
        "over_limit",
    )


def target_set_resolve(spark, sf_dir):
    return S.target_set_resolve(
        fixture(spark, sf_dir, "namespace_listed"), fixture(spark, sf_dir, "namespace"), ["cluster"]
    )


def outcome_tally(spark, sf_dir):
    outcomes = fixture(spark, sf_dir, "namespace").withColumn("ok", ~F.contains("name", F.lit("77")))
    return S.outcome_tally(outcomes, ["cluster"])


def nodepool_flatten(spark, sf_dir):
    from ..sources.schemas import NODE_POOL

    df = fixture(spark, sf_dir, "pool_config").withColumn(
        "node_pools", F.from_json("pools", f"array<{NODE_POOL}>")
    )
    out = S.nodepool_flatten(df.drop("pools"), base_labels={"cell": "id", "nodepool": "name"})
    return out.withColumn("labels", _text_of("labels")).withColumn("taints", F.concat_ws(",", "taints"))


QUERIES = {
    f.__name__: f
    for f in (
        state_diff,
        stable_carry_forward,
        tag_merge,
        layered_config,
        layered_config_json,
        keyvalue_flatten_tags,
        keyvalue_flatten_zone_tables,
        keyvalue_flatten_exports,
        retention_sweep_aws,
        retention_sweep_gcp,
        retention_sweep_azure,
        retention_sweep_rules,
        snapshot_merge,
        name_collision_audit,
        target_set_resolve,
        outcome_tally,
        nodepool_flatten,
    )
}

_JUDGED = """pair as (select coalesce(n.id, o.id) as id, coalesce(n.kind, o.kind) as kind, o.id is null as created, n.id is null as deleted,
      o.a as oa, o.b as ob, o.c as oc, o.d as od, n.a as na, n.b as nb, n.c as nc, n.d as nd
    from record_old o full join record_new n using (id)),
  judged as (select *, case kind
      when 'environment' then case when coalesce(oa, '') = '' then 'env_name' else concat_ws(',',
          case when lower(coalesce(ob, '')) <> lower(coalesce(nb, '')) then 'cloud' end,
          case when oc is distinct from nc then 'region' end,
          case when coalesce(od, 'true') <> coalesce(nd, 'true') then 'is_public_endpoint_enabled' end) end
      when 'api_key' then case when coalesce(oa, '') = '' then 'value' else concat_ws(',',
          case when ob is distinct from nb then 'project_name' end,
          case when oc is distinct from nc then 'key_name' end,
          case when od is distinct from nd then 'org_id' end) end
      when 'dns_delegation' then case when ob is distinct from nb then 'subdomain' else '' end
      when 'service_account' then case when coalesce(oa, '') = '' or coalesce(oc, '') = '' then 'client_id'
          when ob is distinct from nb then 'name' else '' end
      when 'gateway_key' then case when ob is distinct from nb then 'environment' else '' end
      else '' end as r,
    case kind when 'environment' then ob is distinct from nb when 'dns_delegation' then oc is distinct from nc
         when 'metrics_access' then ob is distinct from nb
         when 'uninstaller' then ob is distinct from nb or oc is distinct from nc else false end as u from pair)"""


def _sweep_sql(rules):
    tests = []
    for i, r in enumerate(rules):
        applies = {"any": "true", "current": "is_current", "noncurrent": "not is_current"}[r.applies_to]
        due = f"{r.clock} + interval {r.days} day"
        sign = ">=" if r.inclusive else ">"
        tests.append(
            f"select object_key, nr as row_nr, '{r.name}' as rule, {due} as due from numbered where {applies} "
            f"and starts_with(object_key, '{r.prefix}') and timestamp '{AS_OF}' {sign} {due}"
        )
    return oracle(
        f"""with numbered as materialized (select *, row_number() over () as nr from object),
            hit as ({" union all ".join(tests)}),
            first as (select * from (select *, row_number() over (partition by row_nr order by due, rule) as nr from hit) x where nr = 1)
            select object_key, rule, strftime(due, '%Y-%m-%d') as due, count(*) as n from first group by all""",
        "object",
    )


_CELL = """t as (select id, environment, pool, left(regexp_replace(lower(organisation), '[^a-z0-9]', '', 'g'), 16) as org,
      right(string_split(environment, '.')[1], 4) as e, string_split(environment, '.')[1] as sub from tenant),
    u as (select *, org || 'byoc' || replace(e, '-', '') as flat, instr(org || 'byoc', 'byoc') as pos from t),
    names as (
      select id, 'cell' as kind, org || '-byoc-' || e as name, 63 as allowed from u
      union all select id, 'storage', 'pcdata' || left(substring(flat, 1, pos - 1), greatest(0, 18 - length(substring(flat, pos)))) || substring(flat, pos), 24 from u
      union all select id, 'vault', 'kv-' || left(org, 21 - 6 - length(e)) || '-byoc-' || e, 24 from u
      union all select id, 'account', 'writer-' || left(org, 23 - 6 - length(e)) || '-byoc-' || e, 30 from u
      union all select id, 'bucket', trim(left('pc-internal-' || org || '-byoc-' || e, 63), '-'), 63 from u
      union all select id, 'balancer', trim(left(sub || '-priv-alb', 32), '-'), 32 from u
      union all select id, 'pool', left(replace(replace(pool, '-', ''), '_', ''), 12), 12 from u)"""

ORACLES = {
    "state_diff": oracle(
        f"""with {_JUDGED}
            select id, kind, case when created then 'create' when deleted then 'delete' when r <> '' then 'replace'
                   when u then 'update' else 'same' end as action, case when created or deleted then '' else r end as replaces
            from judged""",
        "record_old",
        "record_new",
    ),
    "stable_carry_forward": oracle(
        f"""with {_JUDGED},
            f as (select id, kind,
                    case when not created and r = '' and kind in ('environment', 'api_key', 'metrics_key', 'service_account',
                              'metrics_access', 'gateway_key') then oa else na end as a, nb as b,
                    case when not created and r = '' and kind in ('metrics_key', 'service_account', 'metrics_access',
                              'gateway_key') then oc else nc end as c, nd as d
                  from judged where not deleted)
            select id, case kind
              when 'environment' then concat_ws(';', 'cloud=' || b, 'env_name=' || a, 'is_public_endpoint_enabled=' || d, 'region=' || c)
              when 'api_key' then concat_ws(';', 'key_name=' || c, 'org_id=' || d, 'project_name=' || b, 'value=' || a)
              when 'dns_delegation' then concat_ws(';', 'nameservers=' || c, 'subdomain=' || b, 'unused=' || a, 'zone=' || d)
              when 'metrics_key' then concat_ws(';', 'api_key=' || a, 'key_id=' || c, 'name=' || b, 'org_id=' || d)
              when 'service_account' then concat_ws(';', 'client_id=' || a, 'client_secret=' || c, 'name=' || b, 'note=' || d)
              when 'metrics_access' then concat_ws(';', 'amp_region=' || a, 'amp_remote_write_endpoint=' || c, 'note=' || d,
                                                   'workload_role_arn=' || b)
              when 'gateway_key' then concat_ws(';', 'environment=' || b, 'key=' || a, 'key_id=' || c, 'note=' || d)
              else concat_ws(';', 'image=' || b, 'kubeconfig=' || c, 'note=' || d, 'unused=' || a) end as props
            from f""",
        "record_old",
        "record_new",
    ),
    "tag_merge": oracle(
        """select id, concat_ws(',', case when has_extra then 'Name=' || name end, case when owner is not null then 'owner=' || owner end,
             case when has_extra then 'partner=mine' when cloud = 'aws' and env = 'prod' then 'partner=live' end,
             case when cloud = 'aws' and env <> 'prod' then 'test-partner=other' end,
             case when cloud <> 'aws' then 'x-managed-by=tool' end, case when cloud = 'aws' then 'x:managed-by=tool' end) as tags
           from tagged""",
        "tagged",
    ),
    "layered_config": oracle(
        """select scope, key, value, layer from setting where value <> '' qualify row_number() over (partition by scope, key
             order by case layer when 'env' then 1 when 'saved' then 2 else 3 end, value) = 1""",
        "setting",
    ),
    "layered_config_json": oracle(
        "with w as (select * from setting where value <> '' qualify row_number() over (partition by scope, key "
        "order by case layer when 'env' then 1 when 'saved' then 2 else 3 end, value) = 1), "
        "s as (select scope, " + ", ".join(f"max(value) filter (key = '{k}') as {k}" for k in SETTINGS) + " from w group by scope) "
        "select scope, '{' || concat_ws(',', "
        + ", ".join(
            f"""'"{k}":"' || """ + {"region": "coalesce(region, 'here')", "env": "coalesce(env, 'prod')"}.get(k, k) + """ || '"'"""
            for k in SETTINGS
        )
        + ") || '}' as config from s",
        "setting",
    ),
    "keyvalue_flatten_tags": oracle(
        """with p as (select id, trim(unnest(string_split(tags, ','))) as e, unnest(range(0, len(string_split(tags, ',')))) as i from keyvalue),
           q as (select id, i, trim(string_split(e, '=')[1]) as key, trim(substring(e, instr(e, '=') + 1)) as value from p where contains(e, '='))
           select id, key, value from q qualify row_number() over (partition by id, key order by i desc) = 1""",
        "keyvalue",
    ),
    "keyvalue_flatten_zone_tables": oracle(
        """with t as (select id, string_split(replace(zone_tables, ' ', ''), ',') as es from keyvalue),
           p as (select id, unnest(es) as e, unnest(range(0, len(es))) as i from t),
           q as (select id, i, e, string_split(e, '=')[1] as key, case when contains(e, '=') then substring(e, instr(e, '=') + 1) else '' end as value
                 from p where e <> ''),
           r as (select *, key <> '' and starts_with(value, 'rtb-') as ok from q)
           select id, case when ok then key end as key, case when ok then value end as value, e as entry, ok from r
           qualify not ok or row_number() over (partition by id, key, ok order by i desc) = 1""",
        "keyvalue",
    ),
    "keyvalue_flatten_exports": oracle(
        r"""with t as (select id, string_split(exports, chr(10)) as es from keyvalue),
           p as (select id, unnest(es) as l, unnest(range(0, len(es))) as i from t),
           q as (select id, i, substring(l, 8) as e from p where starts_with(l, 'export ')),
           r as (select id, i, string_split(e, '=')[1] as key, substring(e, instr(e, '=') + 1) as value, contains(e, '=') as ok from q)
           select id, case when ok then key end as key, case when ok then value end as value, ok from r
           qualify not ok or row_number() over (partition by id, key, ok order by i desc) = 1""",
        "keyvalue",
    ),
    "retention_sweep_aws": _sweep_sql(S.aws_rules()),
    "retention_sweep_gcp": _sweep_sql(S.gcp_rules()),
    "retention_sweep_azure": _sweep_sql(S.azure_rules()),
    "retention_sweep_rules": oracle(
        f"""with o as (select *, row_number() over () as nr from object_listed),
            hit as (select o.*, rule, case clock when 'modified' then modified else noncurrent_since end + to_days(days) as due, inclusive
                    from o join retention_rule r on o.account = r.account and starts_with(object_key, prefix)
                     and (applies_to = 'any' or is_current = (applies_to = 'current'))),
            first as (select * from hit where case when inclusive then timestamp '{AS_OF}' >= due else timestamp '{AS_OF}' > due end
                      qualify row_number() over (partition by nr order by due, rule) = 1)
            select account, object_key, rule, strftime(due, '%Y-%m-%d') as due, count(*) as n from first group by all""",
        "object_listed",
        "retention_rule",
    ),
    "snapshot_merge": oracle(
        """select * from record_new union all
           select * from record_old where id not in (select id from record_new)""",
        "record_old",
        "record_new",
    ),
    "name_collision_audit": oracle(
        f"""with {_CELL}
            select kind, name, count(*) as n_owners, min(id) as first_owner, max(id) as last_owner, length(name) as n_chars,
                   length(name) > allowed as over_limit from names group by kind, name, allowed
            having count(*) > 1 or length(name) > allowed""",
        "tenant",
    ),
    "target_set_resolve": oracle(
        f"""with extra as (select unnest([{", ".join(f"'{e}'" for e in S.EXTRA_TARGETS)}]) as name)
            select cluster, name from namespace where (cluster, name) in (select cluster, name from namespace_listed where starts_with(name, 'pc-'))
               or (cluster in (select cluster from namespace_listed) and name in (select name from extra)) group by all""",
        "namespace_listed",
        "namespace",
    ),
    "outcome_tally": oracle(
        """select cluster, count(*) filter (not contains(name, '77')) as n_ok, count(*) filter (contains(name, '77')) as n_failed,
           not bool_or(contains(name, '77')) as passed from namespace group by cluster""",
        "namespace",
    ),
    "nodepool_flatten": oracle(
        """with p as (select id, unnest(case when len(js) = 0 then [json('{}')] else js end) as p
                      from (select id, cast(json(pools) as json[]) as js from pool_config) a),
           f as (select id, p, coalesce(json_extract_string(p, '$.name'), 'default') as name from p)
           select id, name, coalesce(json_extract_string(p, '$.instance_type'), 'r6in.large') as instance_type,
                  coalesce(cast(json_extract(p, '$.min_size') as int), 1) as min_size,
                  coalesce(cast(json_extract(p, '$.max_size') as int), 10) as max_size,
                  coalesce(cast(json_extract(p, '$.desired_size') as int), 3) as desired_size,
                  coalesce(cast(json_extract(p, '$.disk_size_gb') as int), 100) as disk_size_gb,
                  concat_ws(',', 'cell=' || id, 'nodepool=' || coalesce(json_extract_string(p, '$.labels.nodepool'), name),
                            'tier=' || json_extract_string(p, '$.labels.tier')) as labels,
                  coalesce(json_extract_string(p, '$.taints[0].key') || '=' || json_extract_string(p, '$.taints[0].value') || ':'
                     || coalesce(json_extract_string(p, '$.taints[0].effect'), 'NO_SCHEDULE'), '') as taints
           from f""",
        "pool_config",
    ),
}
