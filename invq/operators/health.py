"""Pod health over nested listings: one projection per question, no shuffle.

Pods have ``namespace, name, phase``, ``conditions array<struct<type,status>>`` and ``containers``
and ``inits``, both ``array<struct<ready,restart_count,waiting_reason>>``; see `sources.schemas`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: reasons a container waits for that mean it is stuck
STUCK_REASONS = (
    "CrashLoopBackOff",
    "ImagePullBackOff",
    "ErrImagePull",
    "CreateContainerConfigError",
    "CreateContainerError",
)
RESTARTS = 3
UNSCHEDULABLE = "Unschedulable"


def _given(reason: Column) -> Column:
    return F.nullif(reason, F.lit(""))


def _or_empty(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType))


def unhealthy_pods(pods: DataFrame) -> DataFrame:
    """Pods stuck in a crash or pull loop, or without a node; adds ``reason``.

    A pending pod with no containers counts only when scheduling it was refused.
    """
    containers = _or_empty(pods, "containers")
    refused = F.exists(
        _or_empty(pods, "conditions"),
        lambda c: (c["type"] == "PodScheduled") & (c["status"] == "False"),
    )
    stuck = F.get(
        F.filter(
            containers,
            lambda c: F.coalesce(c["waiting_reason"].isin(*STUCK_REASONS), F.lit(False))
            | (F.coalesce(c["restart_count"], F.lit(0)) >= RESTARTS),
        ),
        F.lit(0),
    )
    waiting_for_node = (F.col("phase") == "Pending") & (F.size(containers) == 0)
    reason = F.when(
        F.coalesce(waiting_for_node, F.lit(False)), F.when(refused, F.lit(UNSCHEDULABLE))
    ).when(stuck.isNotNull(), F.coalesce(_given(stuck["waiting_reason"]), F.lit("restarting")))
    return pods.withColumn("reason", reason).where(F.col("reason").isNotNull())


def not_ready_pods(
    pods: DataFrame,
    limit: int | None = None,
    per: Sequence[str] = ("cluster",),
    position: Sequence[str] = ("position",),
) -> DataFrame:
    """Pods that are neither finished nor serving, with the ``reason``.

    ``limit`` keeps the first pods of each listing, in listing order; the window ranks within
    a listing and Spark drops later rows before its shuffle, so a huge listing stays cheap.
    """
    containers, inits = _or_empty(pods, "containers"), _or_empty(pods, "inits")
    phase = F.coalesce(F.col("phase"), F.lit(""))
    bare = F.size(containers) == 0
    serving = (phase == "Running") & ~bare & F.forall(
        containers, lambda c: F.coalesce(c["ready"], F.lit(False))
    )
    waiting = F.transform(F.concat(inits, containers), lambda c: _given(c["waiting_reason"]))
    first_reason = F.get(F.array_compact(waiting), F.lit(0))
    scheduled = F.get(
        F.filter(_or_empty(pods, "conditions"), lambda c: c["type"] == "PodScheduled"), F.lit(0)
    )["status"]
    unscheduled = (phase == "Pending") & ~scheduled.eqNullSafe(F.lit("True"))
    reason = F.coalesce(
        first_reason,
        F.when(bare & unscheduled, F.lit(UNSCHEDULABLE)).when(bare, _given(F.col("phase"))),
        F.lit("NotReady"),
    )
    found = pods.where((phase != "Succeeded") & ~serving).withColumn("reason", reason)
    if limit is None:
        return found
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(*position))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")
