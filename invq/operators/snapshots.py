"""Snapshot maintenance: diff, carry-forward, merge, layered settings, retention, target sets."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import hot_join
from ..functions.text import after_first, before_first, strip

_MAP = "map<string,string>"


# -- diff and carry-forward --------------------------------------------------------------------


@dataclass(frozen=True)
class KindRule:
    """What a change to a record of one kind means.

    ``identity``: fields the old record must have, non-empty; if one lacks, the record is
    replaced on account of the first of them. ``replace``: fields whose change replaces it.
    ``ignore_case``: as replace, compared without case. ``update``: fields whose change updates
    it. ``defaults``: values of missing fields. ``stable``: fields kept from the old record.
    """

    identity: tuple[str, ...] = ()
    replace: tuple[str, ...] = ()
    ignore_case: tuple[str, ...] = ()
    update: tuple[str, ...] = ()
    defaults: Mapping[str, str] = field(default_factory=dict)
    stable: tuple[str, ...] = ()


def kind_rules(image_field: str = "image", access_fields: Sequence[str] = ()) -> dict[str, KindRule]:
    """The rules of the control plane's kinds of record.

    ``image_field`` is the uninstaller's field that names its image; ``access_fields`` are
    further server-assigned fields of metrics access, by the names the records use.
    """
    # fixed values: what these kinds do on change
    return {
        "environment": KindRule(
            identity=("env_name",),
            ignore_case=("cloud",),
            replace=("region", "global_env", "is_public_endpoint_enabled"),
            update=("cloud",),
            defaults={"is_public_endpoint_enabled": "true"},
            stable=("env_name", "org_id", "org_name"),
        ),
        "service_account": KindRule(
            identity=("client_id", "client_secret"),
            replace=("name",),
            stable=("client_id", "client_secret"),
        ),
        "api_key": KindRule(
            identity=("value",),
            replace=("project_name", "key_name", "org_id", "auth0_client_id", "auth0_client_secret"),
            stable=("value", "api_key_id", "project_id"),
        ),
        "dns_delegation": KindRule(replace=("subdomain",), update=("nameservers",)),
        "metrics_key": KindRule(stable=("api_key", "key_id")),
        "metrics_access": KindRule(
            update=("workload_role_arn",),
            stable=(*access_fields, "amp_remote_write_endpoint", "amp_region"),
        ),
        "gateway_key": KindRule(replace=("environment",), stable=("key_id", "key")),
        "uninstaller": KindRule(update=("kubeconfig", image_field, "cloud")),
    }


KIND_RULES = kind_rules()


def _changes(rule: KindRule) -> tuple[Column, Column]:
    """For one kind: the fields that replace (array), and whether anything changed."""

    def value(side: str, name: str, fold: bool = False) -> Column:
        found = F.col(f"{side}_props")[name]
        if name in rule.defaults:
            found = F.coalesce(found, F.lit(rule.defaults[name]))
        return F.lower(F.coalesce(found, F.lit(""))) if fold else found

    def differs(name: str, fold: bool = False) -> Column:
        return ~value("old", name, fold).eqNullSafe(value("new", name, fold))

    replaced = [F.when(differs(f, fold=True), F.lit(f)) for f in rule.ignore_case]
    replaced += [F.when(differs(f), F.lit(f)) for f in rule.replace]
    replaces = F.array_compact(F.array(*replaced)) if replaced else F.array().cast("array<string>")
    updated = F.lit(False)
    for f in rule.update:
        updated = updated | differs(f)
    changed = (F.size(replaces) > 0) | updated
    if rule.identity:
        lacking = F.lit(False)
        for f in rule.identity:
            lacking = lacking | (F.coalesce(F.col("old_props")[f], F.lit("")) == "")
        replaces = F.when(lacking, F.array(F.lit(rule.identity[0]))).otherwise(replaces)
        changed = lacking | changed
    return replaces, changed


def state_diff(
    old: DataFrame,
    new: DataFrame,
    rules: Mapping[str, KindRule] = KIND_RULES,
    key: str = "id",
) -> DataFrame:
    """Per record of either snapshot: create, delete, replace, update or same.

    Snapshots have the key, ``kind`` and ``props`` (map). ``replaces`` lists the fields that
    force a replacement. One full join on the key; the rules are plain expressions over it.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            key,
            F.col("kind").alias(f"{name}_kind"),
            F.col("props").alias(f"{name}_props"),
            F.lit(True).alias(f"in_{name}"),
        )

    both = side(old, "old").join(side(new, "new"), key, "full")
    kind = F.coalesce("new_kind", "old_kind")
    none = F.array().cast("array<string>")
    in_both = F.col("in_old").isNotNull() & F.col("in_new").isNotNull()
    replaces, changed = F.when(F.lit(False), none), F.when(F.lit(False), F.lit(False))
    for name, rule in rules.items():
        fields, any_change = _changes(rule)
        replaces = replaces.when(in_both & (kind == name), fields)
        changed = changed.when(in_both & (kind == name), any_change)
    action = (
        F.when(F.col("in_old").isNull(), "create")
        .when(F.col("in_new").isNull(), "delete")
        .when(F.size("replaces") > 0, "replace")
        .when(F.col("changed"), "update")
        .otherwise("same")
    )
    return both.select(
        key,
        kind.alias("kind"),
        F.coalesce(replaces, none).alias("replaces"),
        F.coalesce(changed, F.lit(False)).alias("changed"),
        "in_old",
        "in_new",
    ).select(key, "kind", action.alias("action"), "replaces")


def stable_carry_forward(
    old: DataFrame,
    new: DataFrame,
    rules: Mapping[str, KindRule] = KIND_RULES,
    key: str = "id",
) -> DataFrame:
    """The new records, with the server-assigned fields of their kind kept from the old ones.

    A record that the rules replace (see `state_diff`), or whose kind changed, is a new one and
    keeps nothing. A stable field the old record lacks is dropped from the new one; records
    without an old version stay as they are.
    """
    before = old.select(key, F.col("kind").alias("old_kind"), F.col("props").alias("old_props"))
    both = new.join(before, key, "left").withColumn("new_props", F.col("props"))
    props = F.col("props")
    carried = props
    for name, rule in rules.items():
        if rule.stable:
            kept, rest = _only(F.col("old_props"), rule.stable), _without(props, rule.stable)
            replaces, _ = _changes(rule)
            lasting = (F.col("kind") == name) & (F.col("old_kind") == name) & (F.size(replaces) == 0)
            known = F.col("old_props").isNotNull() & lasting
            carried = F.when(known, F.map_concat(rest, kept)).otherwise(carried)
    return both.withColumn("props", carried).drop("old_kind", "old_props", "new_props")


# -- merges and layers -------------------------------------------------------------------------


def _only(bag: Column, names: Sequence[str]) -> Column:
    return F.map_filter(bag, lambda k, v: k.isin(*names))


def _without(bag: Column, names: Sequence[str]) -> Column:
    return F.map_filter(bag, lambda k, v: ~k.isin(*names))


def _outside(bag: Column, other: Column) -> Column:
    return F.map_filter(bag, lambda k, v: ~F.map_contains_key(other, k))


def merge_maps(*maps: Column) -> Column:
    """One map of several; a later map's value wins. Null maps count as empty."""
    empty = F.create_map().cast(_MAP)
    merged = F.coalesce(maps[0], empty)
    for later in maps[1:]:
        top = F.coalesce(later, empty)
        merged = F.map_concat(_outside(merged, top), top)
    return merged


def base_tags(
    cloud: Column,
    env: Column,
    managed_key: Mapping[str, str],
    managed_value: str,
    partner: Mapping[str, tuple[tuple[str, str], tuple[str, str]]] | None = None,
) -> Column:
    """The tags every resource gets: a managed-by tag under the cloud's key, and on clouds in
    ``partner`` one of two further tags, the first for production and the second otherwise."""
    tags = F.create_map().cast(_MAP)
    for name, key in managed_key.items():
        managed = F.create_map(F.lit(key), F.lit(managed_value))
        if partner and name in partner:
            live, other = partner[name]
            managed = F.when(
                env == "prod", F.map_concat(managed, F.create_map(*[F.lit(p) for p in live]))
            ).otherwise(F.map_concat(managed, F.create_map(*[F.lit(p) for p in other])))
        tags = F.when(cloud == name, managed).otherwise(tags)
    return tags


def tag_merge(df: DataFrame, *columns: str, into: str = "tags") -> DataFrame:
    """Adds the merge of several tag columns, from the weakest to the strongest."""
    return df.withColumn(into, merge_maps(*[F.col(c) for c in columns]))


def layered_config(
    values: DataFrame, layers: Sequence[str], scope: Sequence[str], tie: Sequence[str] = ()
) -> DataFrame:
    """Per scope and key: the value of the first layer that has a non-empty one.

    ``values`` has ``key``, ``layer`` and ``value``. Layers not listed do not count.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in layers]), F.col("layer"))
    order = F.struct(rank, *[F.col(t) for t in tie])
    given = values.where((F.coalesce("value", F.lit("")) != "") & F.col("layer").isin(*layers))
    return given.groupBy(*scope, "key").agg(
        F.min_by(F.struct("value", "layer"), order).alias("w")
    ).select(*scope, "key", F.col("w.value").alias("value"), F.col("w.layer").alias("layer"))


def layered_config_json(
    resolved: DataFrame,
    keys: Sequence[str],
    scope: Sequence[str],
    defaults: Mapping[str, str] | None = None,
) -> DataFrame:
    """Per scope: the listed keys as one JSON object, with constants for missing ones and
    without the keys that stay null."""
    picked = [F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys]
    wide = resolved.groupBy(*scope).agg(*picked)
    members = [
        F.coalesce(F.col(k), F.lit(defaults[k])).alias(k) if defaults and k in defaults else F.col(k)
        for k in keys
    ]
    return wide.select(*scope, F.to_json(F.struct(*members)).alias("config"))


def _last_wins(entries: Column) -> Column:
    """Entries (structs key, pos, value) without those a later one of the same key replaces.

    Sorted by key and position, the last of a key is the one followed by another key; each is
    zipped with its successor, so this is one sort per row and no search.
    """
    ordered = F.array_sort(entries)
    following = F.slice(ordered, F.lit(2), F.size(ordered))

    def keep(entry: Column, after: Column) -> Column:
        return F.when(~entry["key"].eqNullSafe(after["key"]), entry)

    return F.array_compact(F.zip_with(ordered, following, keep))


def _entry(key: Column, pos: Column, value: Column, text: Column, ok: Column) -> Column:
    return F.struct(
        key.alias("key"), pos.alias("pos"), value.alias("value"), text.alias("entry"), ok.alias("ok")
    )


def keyvalue_flatten(df: DataFrame, text: str, dialect: str) -> DataFrame:
    """Rows (``key``, ``value``, ``entry``, ``ok``) of a key=value text; the last of a key wins.

    Dialects: ``tags`` (comma list, entries without = are skipped), ``zone_tables`` (comma list
    of zone=rtb-id, spaces dropped), ``exports`` (lines ``export K=V``, other lines skipped). In
    the last two, malformed entries come out with ``ok`` false and a null key, for a quarantine.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    if dialect == "tags":
        parts = F.transform(F.split(source, ","), strip)
        parts = F.filter(parts, lambda p: F.contains(p, F.lit("=")))
        entries = F.transform(
            parts,
            lambda p, i: _entry(
                strip(before_first(p, "=")), i, strip(after_first(p, "=")), p, F.lit(True)
            ),
        )
    elif dialect == "zone_tables":
        parts = F.filter(F.split(F.replace(source, F.lit(" "), F.lit("")), ","), lambda p: p != "")

        def zone_table(p: Column, i: Column) -> Column:
            zone, table = before_first(p, "="), after_first(p, "=")
            return _entry(zone, i, table, p, (zone != "") & F.startswith(table, F.lit("rtb-")))

        entries = F.transform(parts, zone_table)
    elif dialect == "exports":
        lines = F.filter(
            F.split(source, r"\r\n|\n|\r"), lambda p: F.startswith(p, F.lit("export "))
        )

        def export(p: Column, i: Column) -> Column:
            body = F.substr(p, F.lit(len("export ") + 1))
            has_value = F.contains(body, F.lit("="))
            return _entry(before_first(body, "="), i, after_first(body, "="), p, has_value)

        entries = F.transform(lines, export)
    else:
        raise ValueError(f"unknown dialect {dialect!r}")
    rest = [c for c in df.columns if c != text]
    split = df.select(*rest, entries.alias("entries"))
    good = _last_wins(F.filter("entries", lambda e: e["ok"]))
    bad = F.transform(
        F.filter("entries", lambda e: ~e["ok"]),
        lambda e: _entry(F.lit(None).cast("string"), e["pos"], F.lit(None).cast("string"), e["entry"], e["ok"]),
    )
    return split.select(*rest, F.inline(F.concat(good, bad))).drop("pos")


# -- retention ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class RetentionRule:
    """Objects under ``prefix`` are due ``days`` after ``clock`` (a timestamp column).

    ``inclusive`` is due at exactly that age, otherwise only past it. ``applies_to`` is current,
    noncurrent or any.
    """

    name: str
    prefix: str
    days: int
    clock: str = "modified"
    inclusive: bool = True
    applies_to: str = "current"


# fixed values: prefixes with their days, and the days old versions are kept
PREFIX_DAYS = {"activity-scrapes/": 30, "janitor/": 7, "lag-reporter/": 14}
OLD_VERSION_DAYS = 3


def aws_rules() -> list[RetentionRule]:
    """Prefix rules on current versions; old versions count from when they became old."""
    rules = [RetentionRule(f"delete-{p.rstrip('/')}", p, d) for p, d in PREFIX_DAYS.items()]
    return [*rules, RetentionRule("old-versions", "", OLD_VERSION_DAYS, "noncurrent_since", True, "noncurrent")]


def gcp_rules() -> list[RetentionRule]:
    """As above, but the prefix rules also hit old versions by their own age."""
    rules = [
        RetentionRule(f"delete-{p.rstrip('/')}", p, d, applies_to="any") for p, d in PREFIX_DAYS.items()
    ]
    return [*rules, RetentionRule("old-versions", "", OLD_VERSION_DAYS, "noncurrent_since", True, "noncurrent")]


def azure_rules(data: str = "data", janitor: str = "janitor", internal: str = "internal") -> list[RetentionRule]:
    """Paths start with a container; ages count from creation and must be passed."""
    paths = {
        "activity-scrapes": f"{data}/activity-scrapes/",
        "janitor": f"{janitor}/",
        "lag-reporter": f"{internal}/lag-reporter/",
    }
    rules = [
        RetentionRule(f"delete-{name}", path, PREFIX_DAYS[f"{name}/"], inclusive=False)
        for name, path in paths.items()
    ]
    return [*rules, RetentionRule("old-versions", "", OLD_VERSION_DAYS, inclusive=False, applies_to="noncurrent")]


def retention_sweep(objects: DataFrame, rules: Sequence[RetentionRule], as_of: Column) -> DataFrame:
    """Objects due for deletion at ``as_of``, with the ``rule`` that was due first and ``due``.

    Objects have ``object_key``, ``is_current`` and the clock columns. The rules are a literal
    list, so this is one pass over the listing without a join.
    """
    hits, due_by_any = [], F.lit(False)
    for rule in rules:
        applies = F.startswith(F.col("object_key"), F.lit(rule.prefix))
        if rule.applies_to != "any":
            wanted = F.col("is_current") == (rule.applies_to == "current")
            applies = applies & wanted
        due = F.col(rule.clock) + F.expr(f"interval {rule.days} days")
        past = as_of >= due if rule.inclusive else as_of > due
        due_by_any = due_by_any | (applies & past)
        hits.append(F.when(applies & past, F.struct(due.alias("due"), F.lit(rule.name).alias("rule"))))
    first = F.least(*hits) if len(hits) > 1 else hits[0]
    return (
        objects.where(due_by_any)
        .withColumn("__hit", first)
        .select(*objects.columns, "__hit.rule", "__hit.due")
    )


#: Rules that are sent to every task; more are joined by shuffle.
RULES_SENT = 20_000
#: Words of 64 bits in the map of prefixes that rules name, which every task gets (at most 4 MB).
PREFIX_WORDS = 2**18


def prefix_ladder(key: Column, separator: str = "/", lengths: Sequence[int] = ()) -> Column:
    """The prefixes of a key that a rule may name: the empty one, those that end with the separator, and those of
    the given lengths, longest first and each once."""
    parts = F.split(key, re.escape(separator))
    ends = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(ends, lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), separator), F.lit(separator)))
    long_enough = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length(key))
    given = F.transform(long_enough, lambda n: F.substr(key, F.lit(1), n))
    every = F.array_distinct(F.concat(cut, given, F.array(F.lit(""))))
    return F.array_sort(every, lambda a, b: F.char_length(b) - F.char_length(a))


def _earliest_rules(rules: DataFrame, scope: Sequence[str], clocks: Sequence[str]) -> DataFrame:
    """The rules that can be due first: of those alike in all but name and days, the one with the least days.

    Whatever object they meet, that one is due no later than the others, and by name before those due with it.
    """
    alike = [*scope, "prefix", "clock", F.coalesce("inclusive", F.lit(False)).alias("inclusive"), "applies_to"]
    known = rules.where(F.col("days").isNotNull() & F.col("clock").isin(*clocks))
    first = known.groupBy(*alike).agg(F.min(F.struct("days", "rule")).alias("__first"))
    return first.select(*scope, "__first.rule", "prefix", "__first.days", "clock", "inclusive", "applies_to")


def _named_by_rules(asked: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The asked rows but for most of those whose keys no rule has, by a bitmap of hashes."""
    if any(asked.schema[k].dataType != rules.schema[k].dataType for k in keys):
        return asked  # equal values may have other hashes
    hashed = F.xxhash64(*keys)
    word = F.pmod(hashed, F.lit(PREFIX_WORDS)).alias("__word")
    bit = F.call_function("shiftright", hashed, F.lit(32)).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
    flag = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    bits = rules.select(word, flag.alias("__flag")).groupBy("__word").agg(F.bit_or("__flag").alias("__bits"))
    looked_up = asked.select("*", word, flag.alias("__flag")).join(F.broadcast(bits), "__word")
    return looked_up.where(F.col("__bits").bitwiseAND(F.col("__flag")) != 0).select(*asked.columns)


def retention_sweep_by_rules(
    objects: DataFrame,
    rules: DataFrame,
    as_of: Column,
    scope: Sequence[str] = ("account",),
    clocks: Sequence[str] = ("modified", "noncurrent_since"),
    separator: str = "/",
    rules_sent: int = RULES_SENT,
) -> DataFrame:
    """`retention_sweep` with any number of rules per account, given as a table.

    ``rules`` has the scope, ``rule``, ``prefix``, ``days``, ``clock`` (one of ``clocks``), ``inclusive`` and
    ``applies_to``. An object meets them by equality of the prefixes it has: those that end with the separator, and those
    as long as rules that end elsewhere (at most as many lengths as a key has characters). Equal objects are
    asked about once, so an object is known by its columns, and all rules it meets come together again. It meets
    a few rules a prefix, however many have that prefix, since only those that can be due first are left.
    """
    scope, columns = list(scope), objects.columns
    rules = _earliest_rules(rules, scope, clocks)
    odd = rules.where((F.col("prefix") != "") & ~F.endswith(F.col("prefix"), F.lit(separator)))
    lengths = [r.n for r in odd.select(F.char_length("prefix").alias("n")).distinct().collect()]
    listed = objects.groupBy(*columns).agg(F.count(F.lit(1)).alias("__copies"))
    asked = listed.withColumn("prefix", F.explode(prefix_ladder(F.col("object_key"), separator, sorted(lengths))))
    keys = [*scope, "prefix"]
    if rules.limit(rules_sent + 1).count() <= rules_sent:
        met = asked.join(F.broadcast(rules), keys)
    else:
        # no pass to count hot keys: a key has few rules now, and a merge join reads its objects as they come
        met = _named_by_rules(asked, rules, keys).hint("merge").join(rules, keys)
    from_clock = F.coalesce(*[F.when(F.col("clock") == c, F.col(c)) for c in clocks])
    due = from_clock + F.make_dt_interval(F.col("days"))
    applies = (F.col("applies_to") == "any") | (F.col("is_current") == (F.col("applies_to") == "current"))
    past = F.when(F.col("inclusive"), as_of >= due).otherwise(as_of > due)
    first = met.where(applies & past).groupBy(*columns, "__copies").agg(F.min(F.struct(due.alias("due"), "rule")).alias("__hit"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))
    return first.withColumn("__copy", copies).select(*columns, "__hit.rule", "__hit.due")


# -- target sets and node pools ----------------------------------------------------------------

# fixed values: where registry credentials always go, besides the listed names
TARGET_PREFIX = "pc-"
EXTRA_TARGETS = ("prometheus", "metering", "tooling", "gloo-system", "kube-system", "foundationdb")


def target_set_resolve(
    listed: DataFrame,
    existing: DataFrame,
    scope: Sequence[str],
    prefix: str = TARGET_PREFIX,
    extras: Sequence[str] = EXTRA_TARGETS,
) -> DataFrame:
    """Per scope: the listed names with the prefix and the extra names, of those that exist."""
    keys = [*scope, "name"]
    by_prefix = listed.where(F.startswith("name", F.lit(prefix))).select(*keys)
    extra = F.array(*[F.lit(e) for e in extras if e])
    by_hand = listed.select(*scope).distinct().select(*scope, F.explode(extra).alias("name"))
    wanted = by_prefix.unionByName(by_hand).where(strip(F.col("name")) != "").distinct()
    return hot_join(wanted, existing.select(*keys).distinct(), keys, "left_semi")


def outcome_tally(outcomes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Successes and failures per scope (``ok`` boolean); passed without failures."""
    return (
        outcomes.groupBy(*scope)
        .agg(
            F.count_if(F.col("ok")).alias("n_ok"),
            F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("n_failed"),
        )
        .withColumn("passed", F.col("n_failed") == 0)
    )


# fixed values: the pool a deployment gets when it names none, and a pool's default fields
POOL_DEFAULTS = {
    "name": "default",
    "instance_type": "r6in.large",
    "min_size": 1,
    "max_size": 10,
    "desired_size": 3,
    "disk_size_gb": 100,
}
TAINT_EFFECT = "NO_SCHEDULE"


def nodepool_flatten(
    deployments: DataFrame, pools: str = "node_pools", base_labels: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per node pool; a deployment without pools gets the default one.

    ``base_labels`` maps a label to the column its value comes from (``name`` is the pool's); the
    pool's own labels win. Taints become ``key=value:effect``.
    """
    rest = [c for c in deployments.columns if c != pools]
    at_least_one = F.when(
        F.size(F.coalesce(F.col(pools), F.array().cast(deployments.schema[pools].dataType))) > 0,
        F.col(pools),
    )
    rows = deployments.select(*rest, F.explode_outer(at_least_one).alias("pool"))
    fields = [
        F.coalesce(F.col(f"pool.{name}"), F.lit(value)).alias(name)
        for name, value in POOL_DEFAULTS.items()
    ]
    flat = rows.select(*rest, *fields, "pool.labels", "pool.taints")
    base = F.create_map().cast(_MAP)
    for label, column in (base_labels or {}).items():
        base = F.map_concat(base, F.create_map(F.lit(label), F.col(column).cast("string")))
    taint_type = "array<struct<key:string,value:string,effect:string>>"
    taints = F.transform(
        F.coalesce("taints", F.array().cast(taint_type)),
        lambda t: F.concat(
            t["key"], F.lit("="), t["value"], F.lit(":"), F.coalesce(t["effect"], F.lit(TAINT_EFFECT))
        ),
    )
    return flat.withColumn("labels", merge_maps(base, F.col("labels"))).withColumn("taints", taints)
