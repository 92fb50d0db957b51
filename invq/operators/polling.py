"""Polled state in batch form: conditions that last, thinning, deadlines, outcomes.

Each has a streaming form in `invq.streaming`. Event times are microseconds (``at_us``), taken from a
timestamp column; ``order`` breaks ties between rows of one time.

A key may hold a large share of all rows. Whatever needs the order of a key's rows is therefore
done per (key, stretch of time) first; what is left per key is one or two rows per stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import MICROS, micros
from ..functions.skew import hot_join

# fixed values: seconds a condition must last, between emissions, and until a deadline
GRACE = 120
THROTTLE = 300
REACH_TIMEOUT = 900
SETTLE = 180
JOB_TIMEOUT = 1800
VERIFY_ATTEMPTS = 30

STRETCH = 3600


# -- conditions that last ----------------------------------------------------------------------


def poll_observations(
    polls: DataFrame,
    seen: DataFrame,
    scope: Sequence[str],
    keys: Sequence[str],
    ignore_failed: bool = False,
) -> DataFrame:
    """Observations of keys that full listings show: a key a poll does not list was absent.

    ``polls`` has one row per poll (scope, ``poll_seq``, ``ts``, ``poll_ok``), ``seen`` one per
    poll and key. A failed poll lists nothing and so resets every key, unless
    ``ignore_failed``, which skips it. The result suits `sustained_condition`: present rows,
    ``breaks`` telling that the key was absent from the poll before.
    """
    scope, keys = list(scope), list(keys)
    counted = polls.where(F.col("poll_ok")) if ignore_failed else polls
    number = F.row_number().over(Window.partitionBy(*scope).orderBy("poll_seq"))
    numbered = counted.withColumn("nr", number).where(F.col("poll_ok"))
    present = (
        seen.select(*scope, "poll_seq", *keys)
        .distinct()
        .join(numbered.select(*scope, "poll_seq", "nr", "ts"), [*scope, "poll_seq"])
    )
    # the poll number is part of the key, so no key of this join is hot
    previous = present.select(*scope, *keys, (F.col("nr") + 1).alias("nr"), F.lit(True).alias("kept"))
    return present.join(previous, [*scope, *keys, "nr"], "left").select(
        *scope,
        *keys,
        "poll_seq",
        "ts",
        F.lit(True).alias("present"),
        F.col("kept").isNull().alias("breaks"),
    )


def sustained_condition(
    observations: DataFrame,
    keys: Sequence[str],
    grace_seconds: float = GRACE,
    ts: str = "ts",
    order: Sequence[str] = (),
    stretch_seconds: int = STRETCH,
) -> DataFrame:
    """Keys present without a break for at least the grace: ``since_us``, ``at_us`` and the order columns
    of the first observation at which they were due. Each key comes out once, however often it
    lasts again.

    ``observations`` has the keys, a time and ``present``; an absent row, or ``breaks`` where that
    column exists, starts the clock anew.
    """
    keys, order = list(keys), list(order)
    breaks = F.lit(False)
    if "breaks" in observations.columns:
        breaks = F.coalesce("breaks", breaks)
    obs = observations.select(
        *keys,
        *order,
        micros(observations, ts).alias("at_us"),
        "present",
        (breaks | ~F.col("present")).cast("int").alias("starts"),
    ).withColumn("stretch", F.floor(F.col("at_us") / (stretch_seconds * MICROS)))

    # runs within a stretch; run 0 goes on from before it, the last one may go on after it
    within = Window.partitionBy(*keys, "stretch").orderBy("at_us", *order)
    local = (
        obs.withColumn("run", F.sum("starts").over(within))
        .groupBy(*keys, "stretch", "run")
        .agg(
            F.min(F.when(F.col("present"), F.col("at_us"))).alias("since_us"),
            F.max(F.when(F.col("present"), F.col("at_us"))).alias("until_us"),
        )
        .withColumn("last_run", F.max("run").over(Window.partitionBy(*keys, "stretch")))
    )
    at_edge = (F.col("run") == 0) | (F.col("run") == F.col("last_run"))
    closed = local.where(~at_edge).select(*keys, "since_us", "until_us")
    across = Window.partitionBy(*keys).orderBy("stretch", "run")
    joined = (
        local.where(at_edge)
        .withColumn("whole", F.sum(F.when(F.col("run") > 0, 1).otherwise(0)).over(across))
        .groupBy(*keys, "whole")
        .agg(F.min("since_us").alias("since_us"), F.max("until_us").alias("until_us"))
        .select(*keys, "since_us", "until_us")
    )
    grace = int(grace_seconds * MICROS)
    first_due = (
        closed.unionByName(joined)
        .where(F.col("until_us") - F.col("since_us") >= grace)
        .groupBy(*keys)
        .agg(F.min(F.struct("since_us", "until_us")).alias("span"))
        .select(*keys, "span.*")
    )
    due = hot_join(obs.select(*keys, "at_us", *order), first_due, keys).where(
        F.col("at_us").between(F.col("since_us") + grace, F.col("until_us"))
    )
    first = F.min(F.struct("at_us", *order))
    return due.groupBy(*keys, "since_us").agg(first.alias("first")).select(*keys, "since_us", "first.*")


# -- thinning ----------------------------------------------------------------------------------


def _chain_ends(times: np.ndarray, interval: int) -> np.ndarray:
    """For each time: the last one kept in these times, if it is kept itself."""
    n = len(times)
    step = np.append(np.searchsorted(times, times + interval), n)
    last = np.append(np.arange(n), n)
    # pointer doubling: follow the chains in ever longer steps until all have left the times
    while (step[:n] < n).any():
        reached = last[step]
        last = np.where(reached < n, reached, last)
        step = step[step]
    return times[last[:n]]


#: Step tables that are composed in one group.
FAN_IN = 32


def _enter(upto: np.ndarray, ends: np.ndarray, passed, interval: int):
    """The last event passed after a step table, given the last before it (None: none)."""
    at = 0 if passed is None else int(np.searchsorted(upto, passed + interval))
    return int(ends[at]) if at < len(ends) else passed


def _composed(tables: Sequence[tuple[np.ndarray, np.ndarray]], begin: int, interval: int):
    """One step table for consecutive ones. An entry says up to which threshold what is passed last.

    Only a threshold below ``begin`` + interval can come in from before, so the result is no longer
    than the distinct times of one interval.
    """
    upto, ends = tables[0]
    for more_upto, more_ends in tables[1:]:
        at = np.searchsorted(more_upto, ends + interval)
        goes_on = at < len(more_ends)
        through = np.where(goes_on, more_ends[np.minimum(at, len(more_ends) - 1)], ends)
        # a threshold beyond all of the first table's times meets the second one as it is
        beyond = more_upto > upto[-1]
        upto = np.concatenate((upto, more_upto[beyond]))
        ends = np.concatenate((through, more_ends[beyond]))
    entries = min(len(upto), int(np.searchsorted(upto, begin + interval)) + 1)
    last_of_run = np.append(np.flatnonzero(np.diff(ends[:entries])), entries - 1)
    return upto[last_of_run], ends[last_of_run]


def throttle_per_key(
    events: DataFrame,
    keys: Sequence[str],
    interval_seconds: float = THROTTLE,
    ts: str = "ts",
    order: Sequence[str] = (),
    intervals_per_stretch: int = 16,
) -> DataFrame:
    """Events that pass when at most one per interval may, counted from the last that passed.

    Which event passes depends on all before it, but exactly and in parallel: a stretch of time
    turns the last event passed before it into the last passed in it. (1) Every (key, stretch)
    works that function out as a step table: at most as long as the distinct times in one
    interval, and short in practice since chains merge. (2) The tables of `FAN_IN` neighbours are composed into
    one, level by level, as many levels as the digits of the number of stretches; then, from the top down, every table
    learns what passed before it. So no task ever holds more than `FAN_IN` tables of a key. (3) Every
    (key, stretch) lists what passes, given what passed before.
    """
    keys, order = list(keys), list(order)
    interval = int(interval_seconds * MICROS)
    length = interval * intervals_per_stretch
    at = micros(events, ts).alias("at_us")
    firsts = (
        events.select(*keys, *order, at)
        .groupBy(*keys, "at_us")
        .agg(F.min(F.struct(*order, F.col("at_us").alias("__at"))).alias("first"))
        .select(*keys, "at_us", *[F.col(f"first.{c}").alias(c) for c in order])
        .withColumn("stretch", F.floor(F.col("at_us") / length))
    )
    key_types = ", ".join(_ddl(firsts, c) for c in keys)
    by_stretch = [*keys, "stretch"]

    def table(frame: pd.DataFrame) -> pd.DataFrame:
        starts, times = group_starts(frame, by_stretch), frame["at_us"].to_numpy()
        stretches, upto, last = frame["stretch"].to_numpy(), [], []
        for begin, end in zip(starts, [*starts[1:], len(frame)], strict=True):
            mine = times[begin:end]
            short = _composed([(mine, _chain_ends(mine, interval))], int(stretches[begin]) * length, interval)
            upto.append(short[0])
            last.append(short[1])
        return frame.iloc[starts][by_stretch].assign(upto=upto, ends=last)

    tables = map_groups(
        firsts.select(*by_stretch, "at_us"),
        by_stretch,
        ["at_us"],
        table,
        f"{key_types}, stretch bigint, upto array<bigint>, ends array<bigint>",
    )
    states = _passed_before(tables, keys, key_types, length, interval, _levels(events.select(at), length))

    def emit(frame: pd.DataFrame) -> pd.DataFrame:
        starts, times = group_starts(frame, by_stretch), frame["at_us"].to_numpy()
        passed, kept = frame["passed"], []
        for begin, end in zip(starts, [*starts[1:], len(frame)], strict=True):
            mine, i = times[begin:end], 0
            if not pd.isna(passed.iat[begin]):
                i = int(np.searchsorted(mine, int(passed.iat[begin]) + interval))
            while i < len(mine):
                kept.append(begin + i)
                i = int(np.searchsorted(mine, mine[i] + interval))
        return frame.iloc[kept][[*keys, "at_us", *order]]

    kept_columns = ", ".join(_ddl(firsts, c) for c in [*keys, "at_us", *order])
    return map_groups(firsts.join(states, by_stretch), by_stretch, ["at_us"], emit, kept_columns)


def _levels(times: DataFrame, length: int) -> int:
    """Levels of composition until at most two tables span all stretches."""
    first, last = times.agg(F.min("at_us"), F.max("at_us")).first()
    levels = 1
    while first is not None and last // length // FAN_IN**levels - first // length // FAN_IN**levels > 1:
        levels += 1
    return levels


def _passed_before(
    tables: DataFrame, keys: Sequence[str], key_types: str, length: int, interval: int, levels: int
) -> DataFrame:
    """keys, stretch and ``passed``: the last event passed before each stretch (null: none)."""
    table_type = "upto array<bigint>, ends array<bigint>"
    below = [tables]

    def arrays(frame: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.asarray(u, np.int64), np.asarray(e, np.int64)) for u, e in zip(frame["upto"], frame["ends"], strict=True)]

    for level in range(1, levels):
        span = length * FAN_IN**level

        def compose(frame: pd.DataFrame, span=span) -> pd.DataFrame:
            starts, known, out = group_starts(frame, [*keys, "parent"]), arrays(frame), []
            parents = frame["parent"].to_numpy()
            for begin, end in zip(starts, [*starts[1:], len(frame)], strict=True):
                out.append(_composed(known[begin:end], int(parents[begin]) * span, interval))
            made = frame.iloc[starts][[*keys, "parent"]].rename(columns={"parent": "stretch"})
            return made.assign(upto=[u for u, _ in out], ends=[e for _, e in out])

        named = below[-1].withColumn("parent", F.floor(F.col("stretch") / FAN_IN))
        below.append(map_groups(named, [*keys, "parent"], ["stretch"], compose, f"{key_types}, stretch bigint, {table_type}"))

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        starts, known, before = set(group_starts(frame, [*keys, "parent"]).tolist()), arrays(frame), []
        given = frame["given"]
        for i, (upto, ends) in enumerate(known):
            if i in starts:
                passed = None if pd.isna(given.iat[i]) else int(given.iat[i])
            before.append(passed)
            passed = _enter(upto, ends, passed, interval)
        return frame[[*keys, "stretch"]].assign(passed=pd.array(before, dtype="Int64"))

    above = None
    for level in reversed(range(levels)):
        top = above is None
        # the last level is followed per key; under it, under the table that holds it
        named = below[level].withColumn("parent", F.lit(0).cast("bigint") if top else F.floor(F.col("stretch") / FAN_IN))
        if top:
            named = named.withColumn("given", F.lit(None).cast("bigint"))
        else:
            named = named.join(above.withColumnsRenamed({"stretch": "parent", "passed": "given"}), [*keys, "parent"])
        above = map_groups(
            named, [*keys, "parent"], ["stretch"], follow, f"{key_types}, stretch bigint, passed bigint"
        )
    return above


def group_starts(frame: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Positions where a sorted frame changes group; nulls are one group."""
    changes = np.zeros(len(frame), dtype=bool)
    changes[:1] = True
    for name in columns:
        codes = pd.factorize(frame[name], use_na_sentinel=False)[0]
        changes[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(changes)


def map_groups(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    work: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Hands ``work`` frames of whole, sorted groups. Unlike a grouped pandas function it costs per
    Arrow batch and not per group, so many small groups are cheap; only a group's own rows are
    held together."""
    by = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            starts = group_starts(batch, by)
            goes_on = bool(pending) and (
                len(group_starts(pd.concat([pending[-1].tail(1), batch.head(1)]), by)) == 1
            )
            if goes_on and len(starts) == 1:
                pending.append(batch)
                continue
            whole = pd.concat([*pending, batch.iloc[: starts[-1]]], ignore_index=True)
            if len(whole):
                yield work(whole)
            pending = [batch.iloc[starts[-1] :]]
        if pending:
            yield work(pd.concat(pending, ignore_index=True))

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def _ddl(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


# -- first sight, deadlines, outcomes ----------------------------------------------------------


def first_seen_follow(
    listed: DataFrame, prefix: str, key: str = "name", ts: str = "ts"
) -> DataFrame:
    """Keys with the prefix, each once, with the time it was first listed."""
    wanted = listed.where(F.startswith(key, F.lit(prefix)))
    return wanted.groupBy(key).agg(F.min(micros(listed, ts)).alias("at_us"))


def _with_start(
    rows: DataFrame, key: str, starts: DataFrame | None, ts: str
) -> DataFrame:
    """Adds ``at_us`` and ``start``: given per key, or the time of the key's first row."""
    timed = rows.withColumn("at_us", micros(rows, ts))
    if starts is None:
        starts = timed.groupBy(key).agg(F.min("at_us").alias("start"))
    return hot_join(timed, starts.select(key, "start"), [key])


def reached_within(
    attempts: DataFrame,
    target: str = "target",
    starts: DataFrame | None = None,
    expect: int = 200,
    timeout_seconds: int = REACH_TIMEOUT,
    ts: str = "ts",
    order: Sequence[str] = (),
) -> DataFrame:
    """Per target: whether an attempt got the expected status before the deadline, after how many
    microseconds, and else the last failure (``failure`` of the last attempt before it).

    Attempts have ``status`` (null without an answer) and ``failure``. ``starts`` gives each
    target's start in microseconds; without it the first attempt starts the clock.
    """
    timed = _with_start(attempts, target, starts, ts)
    inside = timed.where(
        (F.col("at_us") >= F.col("start")) & (F.col("at_us") < F.col("start") + timeout_seconds * MICROS)
    )
    good = F.coalesce(F.col("status") == expect, F.lit(False))
    seen = inside.groupBy(target).agg(
        F.min(F.when(good, F.col("at_us") - F.col("start"))).alias("latency_us"),
        F.max_by(F.when(~good, F.col("failure")), F.when(~good, F.struct("at_us", *order))).alias("failure"),
    )
    every = starts.select(target) if starts is not None else attempts.select(target).distinct()
    ok = F.col("latency_us").isNotNull()
    return every.join(seen, target, "left").select(
        target, ok.alias("ok"), "latency_us", F.when(~ok, F.col("failure")).alias("last_failure")
    )


def never_reached(
    attempts: DataFrame,
    target: str = "target",
    starts: DataFrame | None = None,
    settle_seconds: int = SETTLE,
    ts: str = "ts",
    order: Sequence[str] = (),
) -> DataFrame:
    """Per target: the first answer of any status within the settle window, which is a violation."""
    timed = _with_start(attempts, target, starts, ts)
    inside = (F.col("at_us") >= F.col("start")) & (
        F.col("at_us") < F.col("start") + settle_seconds * MICROS
    )
    answered = inside & F.col("status").isNotNull()
    first = F.min(F.when(answered, F.struct("at_us", *order, "status", "start")))
    seen = timed.groupBy(target).agg(first.alias("first"))
    every = starts.select(target).join(seen, target, "left") if starts is not None else seen
    return every.select(
        target,
        F.col("first").isNull().alias("passed"),
        (F.col("first.at_us") - F.col("first.start")).alias("after_us"),
        F.col("first.status").alias("status"),
    )


def job_outcome(
    polls: DataFrame,
    job: str = "job",
    starts: DataFrame | None = None,
    timeout_seconds: int = JOB_TIMEOUT,
    ts: str = "ts",
) -> DataFrame:
    """Per job: succeeded, failed, gone, timed_out or running, and after how many microseconds.

    Polls have ``succeeded`` and ``failed`` counts and ``found``. Within a poll success is looked
    at before failure. A job without an end has timed out once a poll lies at or past the
    deadline, until then it is running.
    """
    timed = _with_start(polls, job, starts, ts).withColumn("elapsed_us", F.col("at_us") - F.col("start"))
    limit = timeout_seconds * MICROS
    found = F.coalesce("found", F.lit(True))
    priority = (
        F.when(found & (F.coalesce("succeeded", F.lit(0)) > 0), 0)
        .when(found & (F.coalesce("failed", F.lit(0)) > 0), 1)
        .when(~found, 2)
    )
    ended = F.when(
        (F.col("elapsed_us") >= 0) & (F.col("elapsed_us") < limit) & priority.isNotNull(),
        F.struct("elapsed_us", priority.alias("priority")),
    )
    names = F.array(F.lit("succeeded"), F.lit("failed"), F.lit("gone"))
    seen = timed.groupBy(job).agg(F.min(ended).alias("end"), F.max("elapsed_us").alias("watched"))
    every = starts.select(job).join(seen, job, "left") if starts is not None else seen
    past = F.coalesce(F.col("watched") >= limit, F.lit(False))
    return every.select(
        job,
        F.coalesce(
            F.get(names, F.col("end.priority")), F.when(past, "timed_out").otherwise("running")
        ).alias("outcome"),
        F.col("end.elapsed_us").alias("elapsed_us"),
    )


def verification_outcome(
    polls: DataFrame, key: str = "service", max_attempts: int = VERIFY_ATTEMPTS
) -> DataFrame:
    """Per key: verified or failed, whichever its numbered attempts (from 0) show first; else
    timed_out once the last allowed attempt was made, until then pending."""
    counts = F.col("attempt") < max_attempts
    ended = F.when(
        counts & F.col("state").isin("verified", "failed"), F.struct("attempt", "state")
    )
    # a poll shows one state; should two rows share an attempt, verified is looked at first
    rank = F.when(
        ended.isNotNull(), F.struct("attempt", (F.col("state") == "failed").alias("later"))
    )
    seen = polls.groupBy(key).agg(
        F.min_by("state", rank).alias("outcome"), F.max("attempt").alias("watched")
    )
    unfinished = F.when(F.col("watched") >= max_attempts - 1, "timed_out").otherwise("pending")
    return seen.select(key, F.coalesce("outcome", unfinished).alias("outcome"))
