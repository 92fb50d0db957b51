"""Readers and writers of landed snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns snapshots are partitioned by; filters on them prune folders.
PARTITIONS = ("account", "region", "snapshot_ts")


def _fields_of(spark: SparkSession, item: str):
    fields = item.strip()
    if not fields.startswith("struct<"):
        raise ValueError("item must be a struct<...> schema")
    return spark.range(0).select(F.from_json(F.lit("{}"), fields).alias("i")).schema["i"].dataType


_CORRUPT = "_unreadable"


def _parsed(spark: SparkSession, path: str, item: str) -> tuple[DataFrame, list[str]]:
    """Lines with their parsed ``item``, and the names of its fields."""
    spec = _fields_of(spark, item)
    names = [f.name for f in spec.fields]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.withColumn("item", F.from_json("value", spec.add(_CORRUPT, "string"), options)), names


def read_listing(spark: SparkSession, path: str, item: str, name: str = "item") -> DataFrame:
    """JSON listings, one object per line, as a struct column with a fixed schema.

    Fields a listing lacks are null. Lines that cannot be read are no items: they are the rows
    of `unreadable_lines`. Folder names such as ``account=.../region=...`` become columns.
    """
    df, names = _parsed(spark, path, item)
    rest = [c for c in df.columns if c not in ("value", "item")]
    read = df.where(F.col("item")[_CORRUPT].isNull())
    return read.select(*rest, F.struct(*[F.col("item")[n].alias(n) for n in names]).alias(name))


def unreadable_lines(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The lines `read_listing` leaves out, with their folder columns and file."""
    df, _ = _parsed(spark, path, item)
    rest = [c for c in df.columns if c not in ("value", "item")]
    bad = df.where(F.col("item")[_CORRUPT].isNotNull())
    return bad.select(*rest, F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def read_pages(
    spark: SparkSession, path: str, item: str, field: str = "value", order: str = r"(\d+)[^/]*$"
) -> DataFrame:
    """Listing pages (``{"<field>": [...], "nextLink": ...}``), one row per item of every page.

    ``position`` orders the items of a listing over all its pages: (page, place in it). The
    page's number is the last group of digits that ``order`` finds in its file's path; pages without
    one are in order of their paths.
    """
    pages = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = F.from_json("value", f"struct<`{field}`:array<{item}>>")
    number = F.nullif(F.regexp_extract("file", order, 1), F.lit("")).cast("bigint")
    items = pages.select("file", number.alias("page"), F.posexplode(parsed[field]).alias("place", "item"))
    return items.select(F.struct("page", "file", "place").alias("position"), "item")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Text logs, one row per line, with the file they came from."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")
    )


def write_snapshot(df: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS) -> None:
    """Appends a snapshot as Parquet, partitioned so that readers prune to what they ask for.

    Rows are clustered by partition before the write; adaptive execution splits a partition
    that is large, so one account with most of the rows still uses many writers.
    """
    df.hint("rebalance", *partitions).write.mode("append").partitionBy(*partitions).parquet(path)


def write_results(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Results as Parquet or JSON lines."""
    df.write.mode("overwrite").format(form).save(path)
