"""Routing questions: what a route, a table and a zone leave by.

Route tables come as two tables: routes (``table_id``, ``position``, ``destination``, ``state``
and one column per kind of target) and associations (``table_id``, ``vpc_id``, ``subnet_id``,
``main``); `sources.schemas` makes both from nested listings. "First" is a minimum by position,
so every step is an aggregation with partial combine followed by an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import join_where_known

# fixed values: the default route, its usable targets by priority, the usable kind of gateway
DEFAULT_ROUTE = "0.0.0.0/0"
TARGETS = (
    "nat_gateway_id",
    "transit_gateway_id",
    "vpc_endpoint_id",
    "network_interface_id",
    "instance_id",
    "core_network_arn",
)
GATEWAY_PREFIX = "vgw-"


def _given(df: DataFrame, name: str) -> Column:
    """A text column with empty as null; a listing without the column has only nulls."""
    return F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def route_target(routes: DataFrame) -> DataFrame:
    """Adds ``target``: what a default route leaves by that a private subnet can use, or null.

    Internet gateways and peering connections are not usable; a route that is not the default
    one has no target. The route's state is not looked at.
    """
    gateway = _given(routes, "gateway_id")
    usable = F.coalesce(
        *[_given(routes, t) for t in TARGETS],
        F.when(F.startswith(gateway, F.lit(GATEWAY_PREFIX)), gateway),
    )
    return routes.withColumn("target", F.when(F.col("destination") == DEFAULT_ROUTE, usable))


def table_egress(
    routes: DataFrame, mode: str = "live", order: Sequence[str] = ("position",)
) -> DataFrame:
    """Tables that have a way out, with its ``target``.

    ``live`` takes the first usable active default route. ``declared`` takes the first default
    route whatever its state, and the table has no way out when that one is not usable.
    """
    defaults = route_target(routes).where(F.col("destination") == DEFAULT_ROUTE)
    rank = F.struct(*order)
    if mode == "live":
        usable = defaults.where((F.col("state") == "active") & F.col("target").isNotNull())
        return usable.groupBy("table_id").agg(F.min_by("target", rank).alias("target"))
    if mode == "declared":
        # a null target must still count as the first, hence the struct
        first = defaults.groupBy("table_id").agg(F.min_by(F.struct("target"), rank).alias("first"))
        return first.select("table_id", "first.target").where(F.col("target").isNotNull())
    raise ValueError(f"mode is live or declared, not {mode!r}")


def _zone_tables(subnets: DataFrame, associations: DataFrame) -> DataFrame:
    """Distinct (vpc, zone, table) over the subnets of a zone."""
    return (
        associations.where(F.col("subnet_id").isNotNull())
        .select("subnet_id", "table_id")
        .join(subnets.select("subnet_id", "vpc_id", "zone"), "subnet_id")
        .select("vpc_id", "zone", "table_id")
        .distinct()
    )


def _main_tables(associations: DataFrame) -> DataFrame:
    return associations.where("main").select("vpc_id", "table_id").distinct()


def zone_egress(
    zones: DataFrame,
    subnets: DataFrame,
    associations: DataFrame,
    egress: DataFrame,
    mode: str = "live",
) -> DataFrame:
    """Per requested zone: how its private subnets would get out.

    ``zones`` has ``vpc_id``, ``zone`` and ``named`` (a table named for the zone, or null);
    ``egress`` is the output of `table_egress` in the same mode. A named table is the only one
    looked at. Otherwise several tables with a way out are ambiguous, one is taken, and with
    none the main table is inherited; in live mode only if it has a way out, else the zone is
    silent. In declared mode a sole table that is the main one counts as inherited.

    ``n_tables`` counts the candidates and ``table_id``/``target`` are the first by id; all of an
    ambiguous zone's tables are rows of `zone_egress_candidates`.
    """
    keys = ["vpc_id", "zone"]
    main = _main_tables(associations)
    flagged = egress.join(
        main.select("table_id", F.lit(True).alias("is_main")), "table_id", "left"
    ).withColumn("is_main", F.coalesce("is_main", F.lit(False)))
    first = F.min(F.struct("table_id", "target", "is_main"))
    own = (
        _zone_tables(subnets, associations)
        .join(flagged, "table_id")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_own"), first.alias("own"))
    )
    inherited = main.join(egress, "table_id").groupBy("vpc_id").agg(
        F.min(F.struct("table_id", "target")).alias("inherited")
    )
    by_name = egress.select(F.col("table_id").alias("named"), F.col("target").alias("named_target"))

    named, n = F.col("named").isNotNull(), F.coalesce("n_own", F.lit(0))
    status = F.when(
        named, F.when(F.col("named_target").isNotNull(), "egressing").otherwise("silent")
    ).when(n > 1, "ambiguous")
    if mode == "live":
        status = (
            status.when(n == 1, "egressing")
            .when(F.col("inherited").isNotNull(), "inherited_main")
            .otherwise("silent")
        )
        fallback = F.col("inherited")
    else:
        status = status.when((n == 1) & ~F.col("own.is_main"), "egressing").otherwise(
            "inherited_main"
        )
        fallback = F.lit(None).cast("struct<table_id:string,target:string>")
    table = F.when(named, F.col("named")).when(n > 0, F.col("own.table_id"))
    target = F.when(named, F.col("named_target")).when(n > 0, F.col("own.target"))
    located = zones.join(own, keys, "left").join(inherited, "vpc_id", "left")
    return (
        join_where_known(located, by_name, "named")  # nearly all zones name no table
        .select(
            *keys,
            status.alias("status"),
            F.when(named, F.lit(1)).otherwise(n).cast("bigint").alias("n_tables"),
            table.alias("own_table"),
            target.alias("own_target"),
            fallback.alias("fallback"),
            named.alias("is_named"),
        )
        .select(
            *keys,
            "status",
            "n_tables",
            F.coalesce("own_table", "fallback.table_id").alias("table_id"),
            F.when(F.col("is_named"), F.col("own_target"))
            .otherwise(F.coalesce("own_target", "fallback.target"))
            .alias("target"),
        )
    )


def egress_verdict(by_zone: DataFrame) -> DataFrame:
    """Per network: ambiguous if any zone is, else silent if any is, else ok."""
    n_ambiguous = F.count_if(F.col("status") == "ambiguous")
    n_silent = F.count_if(F.col("status") == "silent")
    verdict = F.when(F.col("n_ambiguous") > 0, "ambiguous").when(F.col("n_silent") > 0, "silent")
    return (
        by_zone.groupBy("vpc_id")
        .agg(n_ambiguous.alias("n_ambiguous"), n_silent.alias("n_silent"))
        .withColumn("verdict", verdict.otherwise("ok"))
        .withColumn("passed", F.col("verdict") == "ok")
    )


def associable_tables(
    zones: DataFrame, subnets: DataFrame, associations: DataFrame, egress: DataFrame
) -> DataFrame:
    """Per zone the table a new subnet would be associated with: the named one, else the only
    table with a way out that is not the main one. Zones that inherit have no row."""
    keys = ["vpc_id", "zone"]
    leaving = egress.join(_main_tables(associations), "table_id", "left_anti").select("table_id")
    sole = (
        _zone_tables(subnets, associations)
        .join(leaving, "table_id")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min("table_id").alias("sole"))
        .where(F.col("n") == 1)
    )
    table = F.coalesce("named", "sole")
    return (
        zones.join(sole, keys, "left")
        .select(*keys, table.alias("table_id"), F.col("named").isNotNull().alias("is_named"))
        .where(F.col("table_id").isNotNull())
    )


def zone_egress_candidates(
    zones: DataFrame,
    subnets: DataFrame,
    associations: DataFrame,
    routes: DataFrame,
    order: Sequence[str] = ("position",),
) -> DataFrame:
    """Every table a zone sees that carries an active default route, usable or not.

    Per table the first such route with any target decides. The main table is added, as
    inherited, to zones where no table is usable and it is.
    """
    unusable = F.coalesce(_given(routes, "gateway_id"), _given(routes, "peering_id"))
    carried = (
        route_target(routes)
        .where((F.col("destination") == DEFAULT_ROUTE) & (F.col("state") == "active"))
        .select(
            "table_id",
            F.struct(
                F.coalesce("target", unusable).alias("target"),
                F.col("target").isNotNull().alias("usable"),
            ).alias("leaves"),
            F.struct(*order).alias("rank"),
        )
        .where(F.col("leaves.target").isNotNull())
        .groupBy("table_id")
        .agg(F.min_by("leaves", "rank").alias("leaves"))
        .select("table_id", "leaves.*")
    )
    asked = zones.select("vpc_id", "zone").distinct()
    seen = (
        _zone_tables(subnets, associations)
        .join(asked, ["vpc_id", "zone"], "left_semi")
        .join(carried, "table_id")
        .withColumn("inherited", F.lit(False))
    )
    served = seen.where("usable").select("vpc_id", "zone").distinct()
    main = _main_tables(associations).join(carried.where("usable"), "table_id")
    added = (
        asked.join(served, ["vpc_id", "zone"], "left_anti")
        .join(main, "vpc_id")
        .withColumn("inherited", F.lit(True))
    )
    return seen.unionByName(added.select(*seen.columns))


def override_merge(
    detected: DataFrame, named: DataFrame, zones: DataFrame, egress: DataFrame
) -> DataFrame:
    """Detected tables with the named ones on top, by (vpc_id, zone).

    A table named for a zone not deployed to is rejected; a named table without a way out is kept
    with a warning, since a more specific route may do.
    """
    keys = ["vpc_id", "zone"]
    merged = (
        detected.select(*keys, F.col("table_id").alias("detected"))
        .join(named.select(*keys, F.col("table_id").alias("named")), keys, "full")
        .select(
            *keys,
            F.coalesce("named", "detected").alias("table_id"),
            F.when(F.col("named").isNotNull(), "named").otherwise("detected").alias("source"),
        )
    )
    deployed = zones.select(*keys, F.lit(True).alias("deployed")).distinct()
    ways_out = egress.select("table_id", F.lit(True).alias("leaves"))
    by_hand = F.col("source") == "named"
    return (
        merged.join(deployed, keys, "left")
        .join(ways_out, "table_id", "left")
        .select(
            *keys,
            "table_id",
            "source",
            F.when(by_hand & F.col("deployed").isNull(), "rejected")
            .when(by_hand & F.col("leaves").isNull(), "warning")
            .otherwise("ok")
            .alias("status"),
        )
    )
