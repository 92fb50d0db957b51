"""Streaming forms of the polled-state and log operators.

Each takes and returns a streaming DataFrame. The stateful ones work in event time and need the RocksDB
state store (`state_store_settings`): rows are decided in order of time once the watermark, which trails the
latest row by ``delay``, has passed them, so the results are those of the batch form in
`invq.operators.polling`, in whatever order files come. Rows that come later than that are given
out with their time in ``late_at_us`` and nothing else decided (`results` and `late` tell them apart).

A watermark stands still when nothing comes. ``closing`` is a stream of times (``event_time``) that move it on
without being rows: `run_closed` ends a bounded stream with one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.clock import MICROS, micros
from ..operators import polling as P
from ..operators.logs import log_route_filter, redact_text  # noqa: F401 - they run on streams as is
from ..session import ROCKSDB, scratch
from .processors import (
    LATE,
    DeadlineProcessor,
    KeyedProcessor,
    PackedProcessor,
    PollsProcessor,
    SustainedProcessor,
    ThrottleProcessor,
    packed,
)


def state_store_settings(partitions: int) -> dict[str, str]:
    """Settings for the stateful forms. The number of partitions is fixed when a stream first
    starts, so choose it for the number of keys to come."""
    return {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
    }


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _in_event_time(rows: DataFrame, columns: Sequence[Column | str], delay: str, closing: DataFrame | None) -> DataFrame:
    """The columns of the rows (``at_us`` among them) beside a watermark over their times.

    The engine drops what is older than the watermark. To give such rows out instead, every row is two: its time, which
    moves the watermark and ends there, and the row itself, which has no event time.
    """
    named = rows.select(*columns)
    kind = named.schema.simpleString()
    event_time = F.timestamp_micros("at_us")
    apart = F.array(
        F.struct(event_time.alias("event_time"), F.lit(None).cast(kind).alias("row")),
        F.struct(F.lit(None).cast("timestamp").alias("event_time"), F.struct(*named.columns).alias("row")),
    )
    both = named.select(F.explode(apart).alias("one")).select("one.event_time", "one.row")
    if closing is not None:
        both = both.unionByName(closing.select("event_time", F.lit(None).cast(kind).alias("row")))
    # asked of the event time, so that it is asked after the watermark has seen all times
    return both.withWatermark("event_time", delay).where(F.col("event_time").isNull()).select("event_time", "row.*")


def _packed_in_event_time(rows: DataFrame, place: Sequence[str], delay: str, closing: DataFrame | None) -> DataFrame:
    """The place of the rows (``at_us`` among them) and many rows of it in one value, beside a watermark over their times.

    Each task packs its own rows before the shuffle, so that rows of few places cost no more to hand on than
    their bytes. Nothing is dropped: all times are in the packs, for those that are late by then.
    """
    kinds = {name: rows.schema[name].dataType for name in place}

    def pack(batches):
        return packed(batches, list(kinds))

    known = rows.where(F.col("at_us").isNotNull())
    packs = known.mapInArrow(pack, f"{_fields(rows, place)}, until_us bigint, packed binary")
    both = packs.select(*place, F.timestamp_micros("until_us").alias("event_time"), "packed")
    if closing is not None:
        nowhere = [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
        both = both.unionByName(closing.select(*nowhere, "event_time", F.lit(None).cast("binary").alias("packed")))
    # asked of the event time, so that it is asked after the watermark has seen all times
    return both.withWatermark("event_time", delay).where(F.col("event_time").isNull())


def _decided(timed: DataFrame, processor: KeyedProcessor | PackedProcessor, results: str) -> DataFrame:
    schema = f"{_fields(timed, processor.keys)}, {results}, {LATE} bigint"
    return timed.groupBy(*processor.keys).transformWithState(processor, schema, "Append", "EventTime")


def results(decided: DataFrame) -> DataFrame:
    """What was decided, without the rows that came too late."""
    return decided.where(F.col(LATE).isNull()).drop(LATE)


def late(decided: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows of each key came too late, and the time of the latest of them."""
    came = decided.where(F.col(LATE).isNotNull())
    return came.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_late"), F.max(LATE).alias("last_late_at_us"))


def sustained_condition(
    observations: DataFrame,
    keys: Sequence[str],
    grace_seconds: float = P.GRACE,
    ts: str = "ts",
    order: Sequence[str] = (),
    ttl_seconds: int | None = None,
    delay: str = "0 seconds",
    closing: DataFrame | None = None,
) -> DataFrame:
    """Keys present without a break for at least the grace, each once: since_us, at_us and the order columns of
    the first observation past the grace. With ``ttl_seconds`` a key that has not been present for that
    long is forgotten and may come out again; without it a flag is kept of every key that came out."""
    breaks = F.coalesce("breaks", F.lit(False)) if "breaks" in observations.columns else F.lit(False)
    columns = [*keys, micros(observations, ts).alias("at_us"), *order, "present", breaks.alias("breaks")]
    timed = _in_event_time(observations, columns, delay, closing)
    ttl = None if ttl_seconds is None else ttl_seconds * MICROS
    processor = SustainedProcessor(keys, order, int(grace_seconds * MICROS), ttl)
    return _decided(timed, processor, ", ".join(["since_us bigint, at_us bigint", *[_fields(timed, [o]) for o in order]]))


def sustained_condition_polls(
    polls: DataFrame,
    seen: DataFrame,
    scope: Sequence[str],
    keys: Sequence[str],
    grace_seconds: float = P.GRACE,
    ignore_failed: bool = False,
    slices: int = 1,
    delay: str = "0 seconds",
    closing: DataFrame | None = None,
) -> DataFrame:
    """Keys that every poll of their scope has listed for at least the grace, each once.

    ``polls`` has scope, ``poll_seq``, ``ts`` and ``poll_ok``; several rows of one poll are one, at the earliest of their
    times. ``seen`` has scope, ``poll_seq``, ``ts`` and the keys that the poll listed, at no time before the poll's own.
    Polls of a scope come one after the other in time, numbered upwards. A scope's keys are dealt to
    ``slices`` tasks; each is told of every poll, so a key's absence is seen without the other keys.
    """
    scope, keys = list(scope), list(keys)
    part = F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int")
    common = [*scope, "poll_seq"]
    told = polls.select(
        *common, micros(polls, "ts").alias("at_us"), F.coalesce("poll_ok", F.lit(False)).alias("poll_ok"),
        F.lit(None).cast("int").alias("slice"), *[F.lit(None).cast(seen.schema[k].dataType).alias(k) for k in keys],
    )
    listed = seen.select(
        *common, micros(seen, "ts").alias("at_us"), F.lit(None).cast("boolean").alias("poll_ok"), part.alias("slice"), *keys
    )
    both = told.unionByName(listed)
    timed = _packed_in_event_time(both, [*scope, "slice"], delay, closing)
    # polls, which have no slice, are for all of them
    every = F.when(F.col("slice").isNull(), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array("slice"))
    timed = timed.select(*scope, "event_time", "packed", F.explode(every).alias("slice"))
    processor = PollsProcessor(scope, keys, int(grace_seconds * MICROS), ignore_failed)
    return _decided(timed, processor, f"{_fields(both, keys)}, since_us bigint, at_us bigint").drop("slice")


def throttle_per_key(
    events: DataFrame,
    keys: Sequence[str],
    interval_seconds: float = P.THROTTLE,
    ts: str = "ts",
    order: Sequence[str] = (),
    delay: str = "0 seconds",
    closing: DataFrame | None = None,
) -> DataFrame:
    """Events that pass when at most one per interval may, counted from the last that passed. A key is
    forgotten once the interval is over."""
    timed = _in_event_time(events, [*keys, micros(events, ts).alias("at_us"), *order], delay, closing)
    processor = ThrottleProcessor(keys, order, int(interval_seconds * MICROS))
    return _decided(timed, processor, _fields(timed, ["at_us", *order]))


def first_seen_follow(
    listed: DataFrame, prefix: str, key: str = "name", ts: str = "ts", within: str | None = None
) -> DataFrame:
    """Keys with the prefix, each once. ``within`` (such as '2 days') bounds the state: a key
    that comes back after that long is new again."""
    wanted = listed.where(F.startswith(key, F.lit(prefix)))
    if within is None:
        return wanted.dropDuplicates([key])
    return wanted.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def first_seen_known(spark: SparkSession, path: str) -> DataFrame:
    """What `first_seen_once` has put into its table: key, at_us and the number of the micro-batch."""
    return spark.read.parquet(f"{path}/seen")


def first_seen_once(listed: DataFrame, prefix: str, path: str, key: str = "name", ts: str = "ts") -> DataStreamWriter:
    """Keys with the prefix, each once ever, into a table of the stream's own under ``path``; start it with a trigger.

    The table is the memory: a micro-batch puts in its keys that are not there yet, each with the earliest time it shows,
    so there is no state to grow and rows may come in any order. A micro-batch that is repeated after a failure
    overwrites its own folder, so it adds nothing twice.
    """
    wanted = listed.where(F.startswith(key, F.lit(prefix))).select(key, micros(listed, ts).alias("at_us"))

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(F.min("at_us").alias("at_us"))
        if number:
            before = first_seen_known(spark, path).where(F.col("batch") < number)
            new = new.join(before.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    return wanted.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint")


#: Seconds for which a decided key is remembered after its deadline.
KEEP = 24 * 3600


def _deadline(
    rows: DataFrame,
    key: str,
    outcome: Column,
    detail: Column,
    timeout_seconds: int,
    overdue: str,
    ts: str,
    order: Sequence[str],
    delay: str,
    closing: DataFrame | None,
    keep_seconds: int,
) -> DataFrame:
    columns = [
        key,
        micros(rows, ts).alias("at_us"),
        *order,
        outcome.cast("string").alias("outcome"),
        detail.cast("string").alias("detail"),
    ]
    timed = _in_event_time(rows, columns, delay, closing)
    processor = DeadlineProcessor([key], order, timeout_seconds * MICROS, overdue, keep_seconds * MICROS)
    return _decided(timed, processor, "outcome string, elapsed_us bigint, detail string")


def reached_within(
    attempts: DataFrame,
    target: str = "target",
    expect: int = 200,
    timeout_seconds: int = P.REACH_TIMEOUT,
    ts: str = "ts",
    order: Sequence[str] = (),
    delay: str = "0 seconds",
    closing: DataFrame | None = None,
    keep_seconds: int = KEEP,
) -> DataFrame:
    """Targets as they are reached, or as their deadline passes (``unreached``, with the last
    failure). A target that is tried again later than ``keep_seconds`` past its deadline begins anew."""
    reached = F.when(F.col("status") == expect, F.lit("reached"))
    failure = F.col("failure")
    return _deadline(
        attempts, target, reached, failure, timeout_seconds, "unreached", ts, order, delay, closing, keep_seconds
    )


def never_reached(
    attempts: DataFrame,
    target: str = "target",
    settle_seconds: int = P.SETTLE,
    ts: str = "ts",
    order: Sequence[str] = (),
    delay: str = "0 seconds",
    closing: DataFrame | None = None,
    keep_seconds: int = KEEP,
) -> DataFrame:
    """Targets as they first answer (``answered``, a violation), or as the settle window passes
    without an answer (``silent``)."""
    answered = F.when(F.col("status").isNotNull(), F.lit("answered"))
    none = F.lit(None)
    return _deadline(attempts, target, answered, none, settle_seconds, "silent", ts, order, delay, closing, keep_seconds)


def job_outcome(
    polls: DataFrame,
    job: str = "job",
    timeout_seconds: int = P.JOB_TIMEOUT,
    ts: str = "ts",
    delay: str = "0 seconds",
    closing: DataFrame | None = None,
    keep_seconds: int = KEEP,
) -> DataFrame:
    """Jobs as they end (succeeded, failed, gone) or as their deadline passes (``timed_out``)."""
    found = F.coalesce("found", F.lit(True))
    ended = (
        F.when(found & (F.coalesce("succeeded", F.lit(0)) > 0), "succeeded")
        .when(found & (F.coalesce("failed", F.lit(0)) > 0), "failed")
        .when(~found, "gone")
    )
    none = F.lit(None)
    return _deadline(polls, job, ended, none, timeout_seconds, "timed_out", ts, (), delay, closing, keep_seconds)


def _run(stream: DataFrame, folder: str) -> StreamingQuery:
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_to_end(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    """Runs a stream over all there is now, into a Parquet table of the shared scratch folder,
    and gives that table. A restart goes on from the checkpoint beside it."""
    folder = scratch(spark, purpose)
    _run(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_closed(
    spark: SparkSession, session: SparkSession, make: Callable[[DataFrame], DataFrame], purpose: str, until_us: int
) -> DataFrame:
    """Runs a stream of ``session`` over all there is now, then goes on from its checkpoint with a time and no rows,
    so that the watermark passes ``until_us`` less the stream's delay. ``make`` takes the closing times."""
    folder = scratch(spark, purpose)
    times = f"{folder}/closing"
    moment = F.timestamp_micros(F.lit(until_us)).alias("event_time")
    session.range(0).select(moment).write.parquet(times)
    reader = session.readStream.schema("event_time timestamp")
    _run(make(reader.parquet(times)), folder)
    session.range(1).select(moment).write.mode("append").parquet(times)
    stream = make(reader.parquet(times))
    _run(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A sibling session with the state-store settings, so that the caller's stay as they are."""
    sibling = spark.newSession()
    for key, value in state_store_settings(partitions or spark.sparkContext.defaultParallelism).items():
        sibling.conf.set(key, value)
    sibling.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return sibling
