"""Tables written between the jobs of an operator, in the folder that all executors share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a finished job go at once; a lost one is made again from its inputs."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of `df`, computed once and read back: later jobs start from the written table.

    The folder lies under spark.checkpoint.dir; whoever set that setting clears it.
    """
    spark = df.sparkSession
    path = scratch(spark, purpose)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


#: Rows of a table that may be sent to every task, and slices that a larger one's keys are cut into.
SENT_ROWS, SLICES = 20_000, 64


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`rows` joined to a written `table` with one row a key, however many rows share a key.

    A table of at most SENT_ROWS rows is sent to the tasks. A larger one is repeated for SLICES slices, and each
    row meets the one that its content's hash names.
    """
    if table.count() <= SENT_ROWS:
        return rows.join(F.broadcast(table), keys, how)
    slice_ = F.pmod(F.xxhash64(*rows.columns), F.lit(SLICES)).cast("int")
    repeated = table.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return rows.withColumn("slice", slice_).join(repeated, [*keys, "slice"], how).drop("slice")
