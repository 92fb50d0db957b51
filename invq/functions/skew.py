"""Joins that keep their balance when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is cut into slices of about this many rows.
HOT_ROWS = 2_000_000

_SLICES, _SLOT = "__slices", "__slot"
_FEW_SLICES, _FEW_SLOT = "__few_slices", "__few_slot"
#: Null keys never match; their rows are spread over so many slots.
_NULL_SLOTS = 1024


def hot_join(
    many: DataFrame,
    few: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join of a side that may have hot keys against a side with few rows per key.

    Keys of ``many`` with at least ``hot_rows`` rows are cut into slices by a hash of the row,
    and only those keys' rows of ``few`` are repeated, once per slice. Cold keys join as they
    are. Rows are neither lost nor doubled, whatever the number of hot keys. Rows with a null
    key match nothing and are spread by their hash alone. Equal rows of one key share a slice.

    ``counts`` (the keys and ``n``) spares a pass where the caller has already counted. In an
    inner join it may also have ``m``, the rows of ``few``: keys hot on that side are then cut
    there as well, and rows of ``many`` repeated. The list of hot keys is broadcast: it holds at
    most one row per ``hot_rows`` rows of either side.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join would repeat rows of the sliced side")
    on = list(on)
    if counts is None:
        counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    two_sided = how == "inner" and "m" in counts.columns
    m = F.col("m") if two_sided else F.lit(0)
    hot = F.broadcast(
        counts.where((F.col("n") >= hot_rows) | (m >= hot_rows)).select(
            *on,
            F.greatest(F.ceil(F.col("n") / hot_rows), F.lit(1)).cast("int").alias(_SLICES),
            F.greatest(F.ceil(m / hot_rows), F.lit(1)).cast("int").alias(_FEW_SLICES),
        )
    )

    def row_hash(df: DataFrame):
        # map columns cannot be hashed; the others tell rows of one key apart
        hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        return F.xxhash64(*[F.col(c) for c in hashable])

    def slot(df: DataFrame, slices: str):
        return F.coalesce(F.pmod(row_hash(df), F.col(slices)).cast("int"), F.lit(0))

    def every(slices: str):
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(slices), F.lit(1)) - 1))

    lacking = F.lit(False)
    for c in on:
        lacking = lacking | F.col(c).isNull()
    spread = F.pmod(row_hash(many), F.lit(_NULL_SLOTS)).cast("int")
    sliced = many.join(hot, on, "left")
    sliced = sliced.withColumn(_SLOT, F.when(lacking, spread).otherwise(slot(many, _SLICES)))
    repeated = few.join(hot, on, "left")
    keys = [*on, _SLOT]
    if two_sided:
        sliced = sliced.withColumn(_FEW_SLOT, every(_FEW_SLICES))
        repeated = repeated.withColumn(_FEW_SLOT, slot(few, _FEW_SLICES))
        keys.append(_FEW_SLOT)
    repeated = repeated.withColumn(_SLOT, every(_SLICES)).drop(_SLICES, _FEW_SLICES)
    return sliced.drop(_SLICES, _FEW_SLICES).join(repeated, keys, how).drop(_SLOT, _FEW_SLOT)


def join_where_known(many: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """Left join on a column that is mostly null: rows without a key are spread, not gathered."""
    spread = F.pmod(F.xxhash64(*[c for c in many.columns if "map<" not in many.schema[c].dataType.simpleString()]), F.lit(_NULL_SLOTS))
    slotted = many.withColumn(_SLOT, F.when(F.col(on).isNull(), spread).otherwise(F.lit(0)).cast("int"))
    zero = F.pmod(F.xxhash64(on), F.lit(1)).cast("int")  # no constant: that would leave the join key
    return slotted.join(few.withColumn(_SLOT, zero), [on, _SLOT], "left").drop(_SLOT)
