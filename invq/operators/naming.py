"""Length-limited resource names, and the audit that finds the ones that collide.

Every name keeps the cell's unique ending whole and shortens the organisation in front of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import before_first, head

# fixed values: name lengths and the mark between organisation and environment
ORGANISATION_LIMIT = 16
STORAGE_LIMIT = 24
VAULT_LIMIT = 24
SERVICE_ACCOUNT_LIMIT = 30
BUCKET_LIMIT = 63
BALANCER_LIMIT = 32
POOL_LIMIT = 12
CELL_MARK = "byoc"


def _no_edge_dashes(text: Column) -> Column:
    return F.btrim(text, F.lit("-"))


def cell_name(organisation: Column, environment: Column) -> Column:
    plain = F.substring(F.regexp_replace(F.lower(organisation), "[^a-z0-9]", ""), 1, ORGANISATION_LIMIT)
    return F.concat(plain, F.lit(f"-{CELL_MARK}-"), F.right(before_first(environment, "."), F.lit(4)))


def storage_account_name(prefix: Column, cell: Column) -> Column:
    """No dashes. The ending starts at the *first* mark of the flattened cell name.

    Null, as the other names are, for a text that is no cell name.
    """
    flat = F.replace(cell, F.lit("-"), F.lit(""))
    at = F.instr(flat, CELL_MARK)
    ending = F.substr(flat, at)
    room = STORAGE_LIMIT - F.length(prefix) - F.length(ending)
    name = F.concat(prefix, head(F.substring(flat, F.lit(1), at - 1), room), ending)
    return F.when(at > 0, name)


def _with_ending(prefix: Column, cell: Column, limit: int) -> Column:
    """``prefix-organisation-mark-XXXX``; the ending starts at the *last* mark."""
    mark = f"-{CELL_MARK}-"
    ending = F.concat(F.lit(mark), F.substring_index(cell, mark, -1))
    front = F.substring(cell, F.lit(1), F.length(cell) - F.length(ending))
    room = limit - F.length(prefix) - 1 - F.length(ending)
    name = F.concat(prefix, F.lit("-"), head(front, room), ending)
    return F.when(F.contains(cell, F.lit(mark)), name)


def key_vault_name(prefix: Column, cell: Column) -> Column:
    return _with_ending(prefix, cell, VAULT_LIMIT)


def service_account_name(prefix: Column, cell: Column) -> Column:
    return _with_ending(prefix, cell, SERVICE_ACCOUNT_LIMIT)


def bucket_name(kind: Column, cell: Column) -> Column:
    whole = F.concat(F.lit("pc-"), kind, F.lit("-"), cell)
    return _no_edge_dashes(F.substring(whole, 1, BUCKET_LIMIT))


def balancer_name(subdomain: Column, private: bool) -> Column:
    whole = F.concat(before_first(subdomain, "."), F.lit("-priv-alb" if private else "-alb"))
    return _no_edge_dashes(F.substring(whole, 1, BALANCER_LIMIT))


def pool_name(name: Column) -> Column:
    return F.substring(F.translate(name, "-_", ""), 1, POOL_LIMIT)


def job_name(prefix: str, version: Column) -> Column:
    plain = F.regexp_replace(F.lower(version), r"[^a-z0-9\-]", "")
    return _no_edge_dashes(F.concat(F.lit(prefix), plain))


def name_collision_audit(
    resources: DataFrame, names: Mapping[str, tuple[Column, int]], owner: Sequence[str]
) -> DataFrame:
    """Names that two owners share or that pass their limit, one row per kind and name.

    ``names`` maps a kind to its derived name and the length allowed. All kinds are derived in
    one pass and counted with partial combine; owners are counted, not listed, because a common
    name may belong to most of them. An owner's row should occur once.
    """
    derived = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(limit).alias("allowed"))
            for kind, (name, limit) in names.items()
        ]
    )
    # the least and greatest of a struct can only be found by sorting every row; those of one column are hashed
    one = owner[0] if len(owner) == 1 else None
    who = F.col("owner")
    if one:
        least = F.when(F.count_if(who.isNull()) == 0, F.min(who))  # a null owner comes first, as in a struct
        first, last = F.struct(least.alias(one)), F.struct(F.max(who).alias(one))
    else:
        first, last = F.min(who), F.max(who)
    return (
        resources.select((F.col(one) if one else F.struct(*owner)).alias("owner"), F.inline(derived))
        .groupBy("kind", "name", "allowed")
        .agg(F.count(F.lit(1)).alias("n_owners"), first.alias("first_owner"), last.alias("last_owner"))
        .withColumn("n_chars", F.length("name").cast("bigint"))
        .withColumn("over_limit", F.col("n_chars") > F.col("allowed"))
        .where((F.col("n_owners") > 1) | F.col("over_limit"))
    )
