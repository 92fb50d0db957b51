"""Snapshots kept current: a keyed table in buckets, changed by whole versions.

A version is a list of which folder holds each bucket, written as one small file once all its data files are there, so
readers see a version whole or not at all, and what a killed write leaves behind is never looked at. A merge
rewrites the buckets that it changes and points to the old folders for all others. Each version has the name of
the snapshot that made it; a snapshot that is already in is not merged again, so a job may be repeated.

    path/data/<folder>/__bucket=<b>/...  rows of a bucket
    path/versions/number=<n>/...         bucket, folder, snapshot and schema, at most one row a bucket

One writer at a time: of two that start from the same version, the later list is the one that counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
_BUCKET = "__bucket"
_LIST = "bucket int, folder string, snapshot string, fields string, number bigint"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """One row a bucket and version: bucket, folder, snapshot, fields and ``number``."""
    try:
        return spark.read.schema(_LIST).parquet(f"{path}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LIST)


def _version(spark: SparkSession, path: str, number: int | None) -> list:
    """The list of a version (the last one if none is named): at most one row a bucket."""
    known = versions(spark, path)
    if number is None:
        number = known.agg(F.max("number")).first()[0]
    return known.where(F.col("number") == number).collect() if number is not None else []


def _rows(spark: SparkSession, path: str, listed: list, fields: T.StructType) -> DataFrame:
    """The rows of the listed buckets, with their bucket."""
    whole = T.StructType([*fields.fields, T.StructField(_BUCKET, T.IntegerType())])
    of: dict[str, list[int]] = {}
    for row in listed:
        of.setdefault(row.folder, []).append(row.bucket)
    out = spark.createDataFrame([], whole)
    for folder, buckets in of.items():
        # the bucket is a folder's partition, so this reads only those that are asked for
        rows = spark.read.schema(whole).parquet(f"{path}/data/{folder}")
        out = out.unionByName(rows.where(F.col(_BUCKET).isin(buckets)))
    return out


def read_snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of a version, the last one if none is named."""
    listed = _version(spark, path, number)
    if not listed:
        raise ValueError(f"no version {'' if number is None else number} in {path}")
    fields = T.StructType.fromJson(json.loads(listed[0].fields))
    return _rows(spark, path, listed, fields).drop(_BUCKET)


def upsert_snapshot(
    df: DataFrame,
    path: str,
    key: Sequence[str],
    snapshot: str,
    buckets: int = BUCKETS,
    merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> int:
    """Merges rows into the table by key and gives the number of the version that has them.

    Rows of ``df`` replace those of their key; keys may be null, and must not repeat in ``df``. ``merge(old, new)`` may
    say otherwise what becomes of the old rows of the buckets that ``df`` touches and the new ones. The number of
    buckets and the columns are those of the first version.
    """
    spark, key = df.sparkSession, list(key)
    known = versions(spark, path)
    done = known.where(F.col("snapshot") == snapshot).agg(F.max("number")).first()[0]
    if done is not None:
        return done
    last = known.agg(F.max("number")).first()[0]
    listed = _version(spark, path, last) if last is not None else []
    if listed:
        buckets = len(listed)
        fields = T.StructType.fromJson(json.loads(listed[0].fields))
        if sorted(fields.names) != sorted(df.columns):
            raise ValueError(f"columns {df.columns} are not those of the table, {fields.names}")
    else:
        fields = df.schema
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    new = df.select(*fields.names).withColumn(_BUCKET, bucket)
    touched = {r[0] for r in new.select(_BUCKET).distinct().collect()}  # at most one a bucket
    old = _rows(spark, path, [r for r in listed if r.bucket in touched], fields)
    if merge is not None:
        merged = merge(old.drop(_BUCKET), new.drop(_BUCKET)).select(*fields.names).withColumn(_BUCKET, bucket)
    else:
        same = F.lit(True)
        for c in [*key, _BUCKET]:
            same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        kept = old.alias("o").join(new.select(*key, _BUCKET).alias("n"), same, "left_anti")
        merged = kept.unionByName(new)
    folder = uuid.uuid4().hex
    # rows of a bucket lie together; adaptive execution splits a bucket that is large
    merged.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/data/{folder}")
    number, text = (0 if last is None else last + 1), json.dumps(fields.jsonValue())
    held = {r.bucket: r.folder for r in listed} or dict.fromkeys(range(buckets), folder)
    held |= dict.fromkeys(touched, folder)
    _publish(spark, path, number, [(b, f, snapshot, text) for b, f in sorted(held.items())])
    return number


def _publish(spark: SparkSession, path: str, number: int, rows: list) -> None:
    """Writes the list of a version; what is there under its number, if anything, is of a write that was killed."""
    made = spark.createDataFrame(rows, _LIST.rsplit(",", 1)[0]).coalesce(1)
    made.write.mode("overwrite").parquet(f"{path}/versions/number={number}")
