"""Event times as microseconds, the same for both timestamp types and any session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a timestamp column; a long column is taken as such."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.LongType):
        return F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(name))
    return F.unix_micros(F.col(name))
