"""Address-space questions: policy, layout, overlap, placement, free space, collapse.

Overlap of aligned blocks is containment, so every range join here is an equi-join of blocks
against their ancestors, made on *distinct* blocks. Two facts keep it balanced whatever the
data looks like:

* a block has at most 33 ancestors, so distinct overlapping pairs are linear in the input;
* no join key is shorter than /16 (wider blocks are cut into /16 pieces), and a /16 has at most
  2^17 - 1 distinct blocks in it, so that is the most rows one key can bring.

Copies of a block are counted, joined once, and joined back with `hot_join`.

Where no scope has more than `FEW_BLOCKS` blocks on the right, which is counted first, comparing all of them is as linear
as 33 ancestors are, and needs one join.

A side made by exploding is many times what the planner takes it for, so these joins are asked to merge: none of their
sides is gathered on the driver to be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cidr as C
from ..functions.skew import HOT_ROWS, hot_join

# fixed values: what the layout accepts and how it cuts a range
MIN_PREFIX = 16
MAX_PREFIX = 20
MAX_ZONES = 3
SLOT_BITS = 4
PUBLIC_PREFIX = 26
PRIVATE_FIRST_SLOT = 4
PRIVATE_SLOTS = 4

# fixed values: blocks the networks themselves reserve (name, first address, prefix)
RESERVED_PROXY_BLOCKS = (
    ("10.100.1.0/24", 174326016, 24),
    ("10.100.2.0/24", 174326272, 24),
)
RESERVED_SERVICE_BLOCKS = (("112.0.0.0/16", 1879048192, 16),)

#: Width no join key goes below; see the module text.
PIVOT = 16

#: Blocks of a scope that a block is compared with one by one.
FEW_BLOCKS = 32


# -- policy and layout -------------------------------------------------------------------------


def range_policy_audit(
    requests: DataFrame,
    cidr: str = "cidr",
    zones: str | None = "zones",
    min_prefix: int = MIN_PREFIX,
    max_prefix: int = MAX_PREFIX,
    max_zones: int = MAX_ZONES,
    private_only: bool = True,
) -> DataFrame:
    """Adds ``net`` (null if unreadable) and ``verdict``: the first rule a range breaks.

    Rules in order: invalid, prefix, zones, not_private; else ok. ``zones`` names a count
    column; pass None and ``private_only=False`` for the shape that limits only the prefix.
    """
    net = F.col("net")
    verdict = F.when(net.isNull(), "invalid").when(
        ~net["prefix"].between(min_prefix, max_prefix), "prefix"
    )
    if zones is not None:
        verdict = verdict.when(F.col(zones) > max_zones, "zones")
    if private_only:
        verdict = verdict.when(C.private_block_of(net).isNull(), "not_private")
    return requests.withColumn("net", C.parse_cidr(F.col(cidr))).withColumn(
        "verdict", verdict.otherwise("ok")
    )


def planned_subnet(net: Column, index: Column, kind: Column) -> Column:
    """The block a zone's subnet is cut to; null past the last slot."""
    slot_size = F.call_function("shiftright", C.block_size(net["prefix"]), F.lit(SLOT_BITS))
    slot = F.when(kind == "public", index).otherwise(PRIVATE_FIRST_SLOT + PRIVATE_SLOTS * index)
    slot_prefix = net["prefix"] + SLOT_BITS
    public_prefix = F.when(net["prefix"] == MIN_PREFIX, slot_prefix).otherwise(
        F.greatest(F.lit(PUBLIC_PREFIX), slot_prefix)
    )
    prefix = F.when(kind == "public", public_prefix).otherwise(net["prefix"] + PRIVATE_SLOTS // 2)
    cut = C.block(net["lo"] + slot * slot_size, prefix)
    return F.when(slot < 2**SLOT_BITS, cut)


def subnet_layout(
    requests: DataFrame, net: str = "net", zones: str = "zones", public: str = "is_public"
) -> DataFrame:
    """One row per subnet a request would cut: zone, zone_index, kind and ``subnet``.

    ``zones`` is the array of zone names in order. Public subnets are cut only with public
    access. The columns of the request other than zones are kept.
    """
    kinds = F.when(F.col(public), F.array(F.lit("public"), F.lit("private"))).otherwise(
        F.array(F.lit("private"))
    )
    kept = [c for c in requests.columns if c != zones]
    return (
        requests.select(*kept, F.posexplode(F.col(zones)).alias("zone_index", "zone"))
        .withColumn("kind", F.explode(kinds))
        .withColumn("subnet", planned_subnet(F.col(net), F.col("zone_index"), F.col("kind")))
    )


# -- overlap -----------------------------------------------------------------------------------


def distinct_nets(df: DataFrame, scope: Sequence[str], net: str, name: str, n: str) -> DataFrame:
    """Distinct blocks per scope with their number of copies, combined before the shuffle."""
    return (
        df.where(F.col(net).isNotNull())
        .groupBy(*scope, F.col(net).alias(name))
        .agg(F.count(F.lit(1)).alias(n))
    )


def _pieces(df: DataFrame, net: str) -> DataFrame:
    block = F.col(net)
    whole = block["prefix"] >= PIVOT
    step = F.lit(2 ** (32 - PIVOT)).cast("bigint")
    starts = F.when(whole, F.array(block["lo"])).otherwise(
        F.sequence(block["lo"], C.block_end(block) - 1, step)
    )
    return df.withColumn("piece", F.explode(starts)).withColumn(
        "width", F.greatest(block["prefix"], F.lit(PIVOT))
    )


def _climb(pieces: DataFrame, up_to: Column) -> DataFrame:
    """Every ancestor key of a piece, from the pivot down to width ``up_to``."""
    return pieces.withColumn("q", F.explode(F.sequence(F.lit(PIVOT), up_to))).withColumn(
        "at", C.truncate(F.col("piece"), F.col("q"))
    )


def few_per_scope(nets: DataFrame, scope: Sequence[str]) -> bool:
    """Whether no scope has more than `FEW_BLOCKS` rows. Null scopes match nothing and do not count."""
    known = nets.dropna(subset=list(scope)) if scope else nets
    held = known.groupBy(*scope).agg(F.count(F.lit(1)).alias("held"))
    return held.where(F.col("held") > FEW_BLOCKS).isEmpty()


def net_pairs(left: DataFrame, right: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Overlapping pairs of distinct blocks: column ``l`` of left with column ``r`` of right.

    Both sides must hold each block once per scope (see `distinct_nets`); their further columns
    are kept. Each pair comes out once.
    """
    scope = list(scope)
    keys = [*scope, "q", "at"]
    kept = [*left.columns, *[c for c in right.columns if c not in scope]]
    if scope and few_per_scope(right, scope):
        met = left.hint("merge").join(right, scope)
        return met.where(C.overlaps(F.col("l"), F.col("r"))).select(*kept)
    lp, rp = _pieces(left, "l"), _pieces(right, "r")

    # the right block holds the left one, or both are wider than the pivot
    holds = (
        _climb(lp, F.col("width"))
        .hint("merge")
        .join(rp.withColumnRenamed("piece", "at").withColumnRenamed("width", "q"), keys)
        # two wide blocks share many pieces: keep the first of their common part
        .where(
            (F.col("width") > PIVOT) | (F.col("piece") == F.greatest(F.col("l.lo"), F.col("r.lo")))
        )
    )
    # the right block lies strictly inside the left one
    lies_in = _climb(rp.where(F.col("width") > PIVOT), F.col("width") - 1).hint("merge").join(
        lp.withColumnRenamed("piece", "at").withColumnRenamed("width", "q"), keys
    )
    return holds.select(*kept).unionByName(lies_in.select(*kept))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    scope: Sequence[str],
    left_net: str,
    right_net: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every (left row, right row) whose blocks overlap within a scope.

    Result columns: the scope, then the other columns of both sides, which must differ in name.
    """
    scope = list(scope)
    extra = [c for c in left.columns if c not in scope]
    shown = [*scope, *extra, *[c for c in right.columns if c not in scope]]
    if scope and few_per_scope(right, scope):
        met = left.hint("merge").join(right, scope)
        return met.where(C.overlaps(F.col(left_net), F.col(right_net))).select(*shown)
    l_nets = distinct_nets(left, scope, left_net, "l", "ln")
    r_nets = distinct_nets(right, scope, right_net, "r", "rn")
    pairs = net_pairs(l_nets, r_nets, scope)
    rows = hot_join(
        right.withColumn("r", F.col(right_net)),
        pairs.select(*scope, "l", "r"),
        [*scope, "r"],
        counts=r_nets.withColumnRenamed("rn", "n"),
        hot_rows=hot_rows,
    )
    # how many rows either side has of a left block is known from the pairs alone
    both = hot_join(
        rows,
        left.withColumn("l", F.col(left_net)),
        [*scope, "l"],
        counts=pairs.groupBy(*scope, "l").agg(F.sum("rn").alias("n"), F.max("ln").alias("m")),
        hot_rows=hot_rows,
    )
    return both.select(*shown)


def overlap_summary(
    left_nets: DataFrame, right_nets: DataFrame, scope: Sequence[str]
) -> DataFrame:
    """Per distinct left block: how many right rows overlap it, and how many hold it.

    Takes the output of `distinct_nets` (``l``/``ln`` and ``r``/``rn``); no row pairs are made.
    """
    holds = C.inside(F.col("l"), F.col("r"))
    return (
        net_pairs(left_nets, right_nets, scope)
        .groupBy(*scope, "l")
        .agg(
            F.sum("rn").alias("n_overlaps"),
            F.sum(F.when(holds, F.col("rn")).otherwise(0)).alias("n_holding"),
            F.min(C.format_cidr(F.col("r"))).alias("first_overlap"),
        )
    )


def range_overlap(planned: DataFrame, existing: DataFrame, scope: Sequence[str] = ("vpc_id",)):
    """Planned subnets that collide with existing subnets not ours, one row per collision.

    ``planned`` is the output of `subnet_layout`; ``existing`` has ``net``, ``subnet_id`` and
    ``is_ours``.
    """
    theirs = existing.where(~F.col("is_ours")).select(
        *scope, "subnet_id", F.col("net").alias("existing")
    )
    return overlap_join(planned.drop("net"), theirs, scope, "subnet", "existing")


def free_ranges(
    requests: DataFrame,
    existing: DataFrame,
    scope: Sequence[str] = ("vpc_id",),
) -> DataFrame:
    """Requests none of whose planned subnets collides with a subnet that is not ours."""
    return _with_taken(requests, existing, scope).where(F.col("n_taken") == 0).drop("n_taken")


def _with_taken(requests: DataFrame, existing: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Adds ``n_taken``: collisions between a request's planned subnets and subnets not ours.

    Requests of one scope and shape have one answer, so it is found per shape and joined back.
    """
    scope = list(scope)
    shape = [*scope, "net", "zones", "is_public"]
    shapes = requests.groupBy(*shape).agg(F.count(F.lit(1)).alias("n"))
    planned = subnet_layout(shapes.drop("n").withColumn("zone_list", F.col("zones")))
    planned = planned.withColumnRenamed("zone_list", "zones").withColumnRenamed("subnet", "l")
    theirs = distinct_nets(existing.where(~F.col("is_ours")), scope, "net", "r", "rn")
    hits = overlap_summary(planned.select(*scope, "l").distinct(), theirs, scope)
    taken = (
        planned.hint("merge")
        .join(hits.select(*scope, "l", "n_overlaps"), [*scope, "l"])
        .groupBy(*shape)
        .agg(F.sum("n_overlaps").alias("n_taken"))
    )
    return hot_join(requests, taken, shape, "left", counts=shapes).withColumn(
        "n_taken", F.coalesce("n_taken", F.lit(0).cast("bigint"))
    )


def fleet_range_conflicts(
    requests: DataFrame,
    networks: DataFrame,
    scope: Sequence[str] = ("account",),
    request_id: str = "range_id",
    nets: Sequence[str] = ("net",),
) -> DataFrame:
    """Per request: overlaps of its block(s) with every readable prefix of the scope's networks.

    ``networks.prefixes`` is an array of texts; unreadable ones are skipped. ``nets`` names the
    request's blocks, three of them for the shape that derives its neighbours. A conflict does
    not fail a non-interactive request. For the conflicts themselves, row by row, see
    `fleet_range_conflict_pairs`.
    """
    scope = list(scope)
    asked = requests.select(
        *scope, request_id, "non_interactive", F.explode(F.array(*nets)).alias("l")
    )
    l_nets = distinct_nets(asked, scope, "l", "l", "ln")
    r_nets = distinct_nets(listed_prefixes(networks), scope, "r", "r", "rn")
    hits = overlap_summary(l_nets, r_nets, scope)
    found = hot_join(asked, hits, [*scope, "l"], "left", l_nets.withColumnRenamed("ln", "n"))
    return (
        found.groupBy(*scope, request_id, "non_interactive")
        .agg(
            F.coalesce(F.sum("n_overlaps"), F.lit(0).cast("bigint")).alias("n_conflicts"),
            F.min("first_overlap").alias("first_conflict"),
        )
        .withColumn("passed", (F.col("n_conflicts") == 0) | F.col("non_interactive"))
    )


def listed_prefixes(networks: DataFrame) -> DataFrame:
    """The readable prefixes of network listings, one row each, as block ``r``.

    Read before they are exploded, and exploded with nulls, so that no inferred filter repeats
    the reading.
    """
    blocks = F.transform("prefixes", lambda p: C.parse_cidr(F.trim(p)))
    rest = [c for c in networks.columns if c != "prefixes"]
    return networks.select(*rest, F.explode_outer(blocks).alias("r")).where(F.col("r").isNotNull())


def fleet_range_conflict_pairs(
    requests: DataFrame,
    networks: DataFrame,
    scope: Sequence[str] = ("account",),
    nets: Sequence[str] = ("net",),
) -> DataFrame:
    """The conflicts behind `fleet_range_conflicts`, one row per request block and prefix."""
    rest = [c for c in requests.columns if c not in nets]
    asked = requests.select(*rest, F.explode(F.array(*nets)).alias("asked"))
    listed = listed_prefixes(networks).withColumnRenamed("r", "listed")
    return overlap_join(asked, listed, scope, "asked", "listed")


def reserved_range_conflicts(
    ranges: DataFrame, nets: Sequence[str] = ("net",), reserved=RESERVED_PROXY_BLOCKS
) -> DataFrame:
    """Adds ``conflicts`` (names of the reserved blocks touched) and ``passed``.

    The reserved list is a literal of a few blocks, so this is a projection, not a join.
    """
    touched = [
        F.when(
            F.greatest(
                *[F.coalesce(C.overlaps(F.col(n), C.lit_block(lo, p)), F.lit(False)) for n in nets],
                F.lit(False),
            ),
            F.lit(name),
        )
        for name, lo, p in reserved
    ]
    return ranges.withColumn("conflicts", F.array_compact(F.array(*touched))).withColumn(
        "passed", F.size("conflicts") == 0
    )


def range_placement_verdict(
    requests: DataFrame,
    blocks: DataFrame,
    subnets: DataFrame,
    scope: Sequence[str] = ("vpc_id",),
) -> DataFrame:
    """Adds ``verdict`` and ``passed`` for putting a request's range in its network.

    In order: taken (a planned subnet collides with one not ours), covered (inside a block the
    network carries), wrong_family (outside the private blocks it numbers from, if any),
    partial_overlap, free. Only associated blocks count.

    Requests of one scope, range and shape have one answer. A shape's own range meets the carried blocks and its
    planned subnets meet the subnets in one join, told apart by ``kind``; the answers are joined back once.
    """
    scope, shape = list(scope), [*scope, "net", "zones", "is_public"]
    own, planned_kind = F.lit(0).alias("kind"), F.lit(1).alias("kind")
    carried = blocks.where(F.col("state") == "associated")
    theirs = subnets.where(~F.col("is_ours"))
    shapes = requests.groupBy(*shape).agg(F.count(F.lit(1)).alias("n"))
    planned = subnet_layout(shapes.drop("n").withColumn("zone_list", F.col("zones")))
    planned = planned.select(*scope, "net", F.col("zone_list").alias("zones"), "is_public", planned_kind, F.col("subnet").alias("l"))
    asked = shapes.select(*shape, own, F.col("net").alias("l")).unionByName(planned)
    there = carried.select(*scope, own, "net").unionByName(theirs.select(*scope, planned_kind, "net"))
    found = distinct_nets(there, [*scope, "kind"], "net", "r", "rn")
    if few_per_scope(found, [*scope, "kind"]):
        met = asked.hint("merge").join(found, [*scope, "kind"]).where(C.overlaps(F.col("l"), F.col("r")))
        hits = met.withColumn("n_overlaps", F.col("rn")).withColumn(
            "n_holding", F.when(C.inside(F.col("l"), F.col("r")), F.col("rn")).otherwise(0)
        )
    else:
        distinct = asked.select(*scope, "kind", "l").distinct()
        summary = overlap_summary(distinct, found, [*scope, "kind"])
        hits = hot_join(asked, summary, [*scope, "kind", "l"])
    judged = hits.groupBy(*shape).agg(
        F.sum(F.when(F.col("kind") == 1, F.col("n_overlaps"))).alias("n_taken"),
        F.sum(F.when(F.col("kind") == 0, F.col("n_overlaps"))).alias("n_overlaps"),
        F.sum(F.when(F.col("kind") == 0, F.col("n_holding"))).alias("n_holding"),
    )
    families = carried.groupBy(*scope).agg(
        *[
            F.bool_or(C.inside(F.col("net"), C.lit_block(lo, p))).alias(f"uses_{i}")
            for i, (_, lo, p) in enumerate(C.PRIVATE_BLOCKS)
        ]
    )
    judged = hot_join(requests, judged, shape, "left", counts=shapes)
    judged = hot_join(judged, families, scope, "left", counts=shapes.groupBy(*scope).agg(F.sum("n").alias("n")))
    judged = judged.withColumn("n_taken", F.coalesce("n_taken", F.lit(0).cast("bigint")))

    uses = [F.coalesce(F.col(f"uses_{i}"), F.lit(False)) for i in range(len(C.PRIVATE_BLOCKS))]
    in_used = [
        u & C.inside(F.col("net"), C.lit_block(lo, p))
        for u, (_, lo, p) in zip(uses, C.PRIVATE_BLOCKS, strict=True)
    ]
    verdict = (
        F.when(F.col("n_taken") > 0, "taken")
        .when(F.col("n_holding") > 0, "covered")
        .when(F.greatest(*uses) & ~F.greatest(*in_used), "wrong_family")
        .when(F.col("n_overlaps") > 0, "partial_overlap")
        .otherwise("free")
    )
    return (
        judged.withColumn("verdict", verdict)
        .withColumn("passed", F.col("verdict").isin("covered", "free"))
        .drop("n_overlaps", "n_holding", *[f"uses_{i}" for i in range(len(C.PRIVATE_BLOCKS))])
    )


# -- free space, neighbours, collapse ----------------------------------------------------------


def free_range_suggest(blocks: DataFrame, scope: Sequence[str] = ("vpc_id",)) -> DataFrame:
    """Per network: the first free /16 of the first private block it numbers from, else null.

    The private blocks hold 256 + 16 + 1 /16s, so a network's used ones are a set of at most 273
    numbers; one aggregation with partial combine, no join. Rows with a null ``net`` (unreadable
    blocks) only keep their network in the result.
    """
    slots, sequences, base = [], [], 0
    net = F.col("net")
    for _, lo, prefix in C.PRIVATE_BLOCKS:
        outer = C.lit_block(lo, prefix)
        count = 2 ** (MIN_PREFIX - prefix)
        first = (F.greatest(net["lo"], F.lit(lo)) - lo) / 65536
        last = (F.least(C.block_end(net), F.lit(lo + count * 65536)) - 1 - lo) / 65536
        used = F.sequence(
            F.floor(first).cast("int") + base, F.floor(last).cast("int") + base
        )
        none = F.array().cast("array<int>")
        slots.append(F.when(F.coalesce(C.overlaps(net, outer), F.lit(False)), used).otherwise(none))
        sequences.append((base, count, lo))
        base += count
    per_network = (
        blocks.select(
            *scope,
            *[
                F.coalesce(C.inside(net, C.lit_block(lo, p)), F.lit(False)).alias(f"in_{i}")
                for i, (_, lo, p) in enumerate(C.PRIVATE_BLOCKS)
            ],
            F.explode_outer(F.flatten(F.array(*slots))).alias("slot"),
        )
        .groupBy(*scope)
        .agg(
            F.collect_set("slot").alias("used"),
            *[F.bool_or(f"in_{i}").alias(f"in_{i}") for i in range(len(C.PRIVATE_BLOCKS))],
        )
    )
    picks = []
    for i, (base, count, lo) in enumerate(sequences):
        all_slots = F.sequence(F.lit(base), F.lit(base + count - 1))
        first_free = F.get(F.array_except(all_slots, F.col("used")), F.lit(0))
        start = (first_free - base).cast("bigint") * 65536 + lo
        picks.append(
            F.when(F.col(f"in_{i}") & first_free.isNotNull(), C.block(start, F.lit(MIN_PREFIX)))
        )
    return per_network.select(*scope, F.coalesce(*picks).alias("suggested"))


def adjacent_range_derive(ranges: DataFrame, net: str = "net") -> DataFrame:
    """Adds ``db`` (the next block of the same size), ``link`` (a /27 after it) and ``verdict``.

    Verdict: overflow when either would pass the end of IPv4, unaligned when no /27 starts
    there, else ok. Both blocks are null unless ok.
    """
    block = F.col(net)
    size = C.block_size(block["prefix"])
    after = block["lo"] + 2 * size
    verdict = (
        F.when(after >= 2**32, "overflow").when(after % 32 != 0, "unaligned").otherwise("ok")
    )
    ok = F.col("verdict") == "ok"
    return (
        ranges.withColumn("verdict", verdict)
        .withColumn("db", F.when(ok, C.block(block["lo"] + size, block["prefix"])))
        .withColumn("link", F.when(ok, C.block(after, F.lit(27))))
    )


def _islands(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merges touching or overlapping [lo, hi) spans per key."""
    ordered = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)
    return (
        spans.withColumn("starts", starts)
        .withColumn("island", F.sum("starts").over(ordered))
        .groupBy(*keys, "island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("island")
    )


def _aligned(spans: DataFrame, widest: int, narrowest: int) -> DataFrame:
    """The fewest aligned blocks that make up each [lo, hi) span.

    At every width at most the first and the last block in the span can lack a parent in it.
    """
    lo, hi, p = F.col("lo"), F.col("hi"), F.col("p")
    size = C.block_size(p)
    first = lo + F.pmod(-lo, size)
    last = hi - F.pmod(hi, size) - size
    parent = C.truncate(F.col("start"), p - 1)
    parent_inside = (p > 0) & (parent >= lo) & (parent + 2 * size <= hi)
    return (
        spans.withColumn("p", F.explode(F.sequence(F.lit(widest), F.lit(narrowest))))
        .where(first + size <= hi)
        .withColumn("start", F.explode(F.array_distinct(F.array(first, last))))
        .where(~parent_inside)
        .withColumn("net", C.block(F.col("start"), p))
        .drop("lo", "hi", "p", "start")
    )


def range_collapse(
    ranges: DataFrame, scope: Sequence[str] = ("vpc_id",), net: str = "net"
) -> DataFrame:
    """The fewest blocks that cover exactly the same addresses, per scope.

    Two levels, so that a scope with most of the rows is still split: first inside each /16
    (at most 2^17 distinct blocks), then over whole /16s of a scope (again at most 2^17).
    """
    scope = list(scope)
    block = F.col(net)
    spans = (
        ranges.where(block.isNotNull())
        .select(*scope, block["lo"].alias("lo"), C.block_end(block).alias("hi"))
        .distinct()
    )
    full = 2 ** (32 - PIVOT)
    narrow = spans.where(F.col("hi") - F.col("lo") < full).withColumn(
        "sixteen", C.truncate(F.col("lo"), F.lit(PIVOT))
    )
    merged = _islands(narrow, [*scope, "sixteen"])
    is_full = F.col("hi") - F.col("lo") == full
    wide = _islands(
        spans.where(F.col("hi") - F.col("lo") >= full).unionByName(
            merged.where(is_full).drop("sixteen")
        ),
        scope,
    )
    wide_blocks = _aligned(wide, 0, PIVOT)
    # a /16 is wholly in a wide block or not at all: an equi-join on its ancestors finds out
    partial = merged.where(~is_full)
    swallowed = (
        partial.select(*scope, "sixteen")
        .distinct()
        .withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(PIVOT))))
        .withColumn("net", C.block(C.truncate(F.col("sixteen"), F.col("p")), F.col("p")))
        .join(wide_blocks, [*scope, "net"], "left_semi")
        .select(*scope, "sixteen")
    )
    left_over = partial.join(swallowed, [*scope, "sixteen"], "left_anti").drop("sixteen")
    return wide_blocks.select(*scope, "net").unionByName(
        _aligned(left_over, PIVOT + 1, 32).select(*scope, "net")
    )


def layout_integrity_audit(
    requests: DataFrame, subnets: DataFrame, request_id: str = "range_id"
) -> DataFrame:
    """Per request: subnets outside its range, overlapping pairs, zones with a wrong count.

    ``subnets`` has the request's id, ``zone`` and ``subnet``. Two per zone are expected with
    public access, one without. Overlaps are counted, not listed.
    """
    key = [request_id]
    zero = F.lit(0).cast("bigint")
    per_zone = F.when(F.col("is_public"), 2).otherwise(1)

    with_range = hot_join(subnets, requests.select(*key, "net"), key)
    outside = with_range.groupBy(*key).agg(
        F.count_if(~C.inside(F.col("subnet"), F.col("net"))).alias("n_outside")
    )

    expected = requests.select(*key, F.explode("zones").alias("zone"), per_zone.alias("expected"))
    found = subnets.groupBy(*key, "zone").agg(F.count(F.lit(1)).alias("found"))
    wrong_zones = (
        found.join(expected, [*key, "zone"], "full")
        .groupBy(*key)
        .agg(F.count_if(~F.col("found").eqNullSafe(F.col("expected"))).alias("n_wrong_zones"))
    )

    nets = distinct_nets(subnets, key, "subnet", "l", "ln")
    same = nets.select(*key, (F.col("ln") * (F.col("ln") - 1) / 2).cast("bigint").alias("pairs"))
    nested = (
        net_pairs(nets, nets.withColumnsRenamed({"l": "r", "ln": "rn"}), key)
        .where(F.col("l.prefix") > F.col("r.prefix"))
        .select(*key, (F.col("ln") * F.col("rn")).alias("pairs"))
    )
    pairs = same.unionByName(nested).groupBy(*key).agg(F.sum("pairs").alias("n_overlap_pairs"))

    out = requests.select(*key)
    for part in (outside, wrong_zones, pairs):
        out = out.join(part, key, "left")
    counted = ["n_outside", "n_wrong_zones", "n_overlap_pairs"]
    return out.select(*key, *[F.coalesce(c, zero).alias(c) for c in counted]).withColumn(
        "passed", F.greatest(*counted) == 0
    )
