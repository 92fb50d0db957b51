"""Session settings the operators are written for, and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Runtime settings worth having on a cluster; all of them are plain Spark SQL options.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("invq")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="invq-"))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for stream checkpoints and written tables.

    It lies in the shared folder named by ``spark.checkpoint.dir``, else in the session's
    warehouse, which executors share too. Nothing here removes it: results are read from it for
    as long as the caller keeps them, so whoever owns that folder clears it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Bytes of the supplied tables that one shuffle partition stands for, and what adaptive execution joins small ones to.
PARTITION_BYTES = 4 * 2**20
ADVISORY = "16MB"


def sized(spark: SparkSession, folder: str) -> SparkSession:
    """The session, or a sibling with as many shuffle partitions as the tables in a folder need.

    A number of partitions that is fixed gives each task a share of the input, and memory, that grow with it.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    held = listed.load(folder).agg(F.sum("length")).first()[0] or 0
    wanted = -(-held // PARTITION_BYTES)
    if wanted <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return spark
    sibling, settings = spark.newSession(), spark.conf.getAll
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": ADVISORY} | settings
    for key, value in (settings | {"spark.sql.shuffle.partitions": str(wanted)}).items():
        if sibling.conf.isModifiable(key):
            sibling.conf.set(key, value)
    return sibling


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application; they need not have it.

    Streams with state also start a Python process beside the driver, which gets no added files: it finds the
    package by the path that it and the workers are started with.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='invq-')}/invq", "zip", package.parent, package.name)
        context.addPyFile(made)
        paths = [made, context.environment.get("PYTHONPATH", "")]
        context.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
        _shipped.add(context.applicationId)
