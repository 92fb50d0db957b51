"""Streams over several micro-batches, in time order and in none, against their batch forms."""

import os
import subprocess
import sys
import time
from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from invq.functions.clock import MICROS, micros
from invq.operators import polling as P
from invq.operators.logs import redact_text
from invq.plans.polling import DAY, HOUR, errors_of_users
from invq.streaming import streams as T
from tests.helpers import rows

EVENTS = "/root/testdata/sf0.001/events.parquet"


def write_files(spark, parts, folder):
    """One file a part, landed in this order; rows within a file are shuffled."""
    now = time.time()
    for i, part in enumerate(parts):
        path = folder / f"{i}.parquet"
        part.orderBy(F.rand(i)).coalesce(1).write.parquet(str(folder / f"tmp{i}"))
        (source,) = (folder / f"tmp{i}").glob("*.parquet")
        path.write_bytes(source.read_bytes())
        os.utime(path, (now - 100 + i * 10,) * 2)
    return str(folder)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """The events in four files, each later than the one before."""
    events = spark.read.parquet(EVENTS)
    cuts = events.approxQuantile("event_id", [0.0, 0.25, 0.5, 0.75, 1.0], 0.0)
    parts = [
        events.where((F.col("event_id") >= cuts[i]) & ((F.col("event_id") < cuts[i + 1]) | F.lit(i == 3)))
        for i in range(4)
    ]
    return write_files(spark, parts, tmp_path_factory.mktemp("events"))


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """The events in four files, each from all over the time, the latest of all in the first."""
    events = spark.read.parquet(EVENTS)
    last = events.agg(F.max("event_id")).first()[0]
    part = F.when(F.col("event_id") >= last - 20, 0).otherwise(F.pmod(F.xxhash64("event_id"), F.lit(4)))
    return write_files(spark, [events.where(part == i) for i in range(4)], tmp_path_factory.mktemp("mixed"))


@pytest.fixture(params=["in order", "mixed"])
def case(request, landed, mixed):
    """Folder of files and how late their rows may come."""
    return (landed, "0 seconds") if request.param == "in order" else (mixed, "60 days")


def stream(session, folder):
    schema = session.read.parquet(EVENTS).schema
    reader = session.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.option("pathGlobFilter", "?.parquet").parquet(folder)


def until(spark, days=0):
    """Just after the latest event, and what the longest delay takes."""
    events = spark.read.parquet(EVENTS)
    return events.agg(F.max(micros(events, "ts"))).first()[0] + 1000 + (60 + days) * DAY * MICROS


def closed(spark, make, case, days=0, purpose="t"):
    """make(stream, **settings) run file by file and closed."""
    folder, delay = case
    session = T.stream_session(spark, 2)

    def made(closing):
        return make(stream(session, folder), delay=delay, closing=closing)

    return T.run_closed(spark, session, made, purpose, until(spark, days))


@pytest.fixture
def progress(monkeypatch):
    """What each run of a stream says at its end."""
    said, run = [], T._run

    def noting(stream, folder):
        query = run(stream, folder)
        said.append(query.recentProgress)
        return query

    monkeypatch.setattr(T, "_run", noting)
    return said


def sustained(events, **settings):
    return T.sustained_condition(errors_of_users(events), ["user_id"], 12 * HOUR, order=["event_id"], **settings)


def test_sustained(spark, case):
    batch = P.sustained_condition(errors_of_users(spark.read.parquet(EVENTS)), ["user_id"], 12 * HOUR, order=["event_id"])
    got = rows(T.results(closed(spark, sustained, case)), "user_id", "since_us", "at_us", "event_id")
    assert got == rows(batch, "user_id", "since_us", "at_us", "event_id") and got


def test_sustained_is_forgotten_after_its_time_to_live(spark, tmp_path, progress):
    """Two lasting spells, far apart: without a time to live the second does not count."""
    start = int(datetime(2024, 1, 1, tzinfo=UTC).timestamp()) * MICROS
    spells = [(1, start + (day * DAY + 60 * i) * MICROS) for day in (0, 1, 20) for i in range(5)]
    data = spark.createDataFrame([(k, t, True) for k, t in spells], "k int, us long, present boolean")
    data = data.select("k", F.timestamp_micros("us").alias("ts"), "present")
    folder = write_files(spark, [data.where("k = 1")], tmp_path)

    def run(ttl):
        session = T.stream_session(spark, 2)

        def make(closing):
            obs = session.readStream.schema(data.schema).option("pathGlobFilter", "?.parquet").parquet(folder)
            return T.sustained_condition(obs, ["k"], 120, ttl_seconds=ttl, closing=closing)

        out = T.results(T.run_closed(spark, session, make, "t", start + 100 * DAY * MICROS))
        return [(since - start) // MICROS // DAY for _, since, _ in rows(out, "k", "since_us", "at_us")]

    assert run(None) == [0]
    assert run(5 * DAY) == [0, 20]
    assert progress[-1][-1]["stateOperators"][0]["numRowsTotal"] == 0


def throttled(events, **settings):
    return T.throttle_per_key(events, ["user_id"], 12 * HOUR, order=["event_id"], **settings)


def test_throttle(spark, case, progress):
    batch = P.throttle_per_key(spark.read.parquet(EVENTS), ["user_id"], 12 * HOUR, order=["event_id"])
    out = T.results(closed(spark, throttled, case, days=1))
    assert rows(out, "user_id", "at_us", "event_id") == rows(batch, "user_id", "at_us", "event_id")
    held = [p["stateOperators"][0]["numRowsTotal"] for run in progress for p in run if p["stateOperators"]]
    assert held[-1] == 0 < max(held)


def attempts(events):
    status = F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 503)
    return events.select(
        F.col("user_id").alias("target"), "event_id", "ts", status.alias("status"),
        F.concat(F.lit("failure of "), F.col("event_id").cast("string")).alias("failure"),
    )


EVER = 1000 * DAY


def test_reached(spark, case, progress):
    batch = P.reached_within(attempts(spark.read.parquet(EVENTS)), timeout_seconds=6 * HOUR, order=["event_id"])
    want = [
        (t, "reached" if ok else "unreached", after, failure)
        for t, ok, after, failure in rows(batch, "target", "ok", "latency_us", "last_failure")
    ]

    def make(events, **settings):
        return T.reached_within(attempts(events), timeout_seconds=6 * HOUR, order=["event_id"], keep_seconds=EVER, **settings)

    got = rows(T.results(closed(spark, make, case, days=2000)), "target", "outcome", "elapsed_us", "detail")
    assert got == sorted(want, key=repr)
    assert {g[1] for g in got} == {"reached", "unreached"}
    assert progress[-1][-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_never_reached(spark, case):
    batch = P.never_reached(attempts(spark.read.parquet(EVENTS)), settle_seconds=6 * HOUR, order=["event_id"])
    want = [(t, "silent" if ok else "answered", after) for t, ok, after in rows(batch, "target", "passed", "after_us")]

    def make(events, **settings):
        return T.never_reached(attempts(events), settle_seconds=6 * HOUR, order=["event_id"], keep_seconds=EVER, **settings)

    got = rows(T.results(closed(spark, make, case, days=1)), "target", "outcome", "elapsed_us")
    assert got == sorted(want, key=repr)


def test_job_outcome(spark, mixed):
    def polls(events):
        ended = F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), 1).otherwise(0)
        return events.select(
            F.floor(F.col("event_id") / 20).alias("job"), "ts", ended.alias("succeeded"), F.lit(0).alias("failed"), F.lit(True).alias("found")
        )

    batch = P.job_outcome(polls(spark.read.parquet(EVENTS)), timeout_seconds=3 * HOUR)
    want = [(j, o if o != "running" else "timed_out", e) for j, o, e in rows(batch, "job", "outcome", "elapsed_us")]

    def make(events, **settings):
        return T.job_outcome(polls(events), timeout_seconds=3 * HOUR, keep_seconds=EVER, **settings)

    got = rows(T.results(closed(spark, make, (mixed, "60 days"), days=1)), "job", "outcome", "elapsed_us")
    assert got == sorted(want, key=repr) and {g[1] for g in got} == {"succeeded", "timed_out"}


def listings(events):
    poll = F.floor(micros(events, "ts") / (6 * HOUR * MICROS))
    named = events.select((F.col("user_id") % 2).alias("scope"), poll.alias("poll_seq"), "ts", (F.col("user_id") % 5).alias("pod"))
    return named.withColumn("poll_ok", F.col("poll_seq") % 11 != 3)


@pytest.mark.parametrize("ignore_failed", [False, True])
def test_absence_from_a_poll_is_seen(spark, case, ignore_failed):
    table = listings(spark.read.parquet(EVENTS))
    polls = table.groupBy("scope", "poll_seq").agg(F.min("ts").alias("ts"), F.first("poll_ok").alias("poll_ok"))
    obs = P.poll_observations(polls, table.select("scope", "poll_seq", "pod"), ["scope"], ["pod"], ignore_failed)
    batch = P.sustained_condition(obs, ["scope", "pod"], 18 * HOUR)

    def make(events, **settings):
        made = listings(events)
        polls = made.select("scope", "poll_seq", "ts", "poll_ok")
        return T.sustained_condition_polls(polls, made, ["scope"], ["pod"], 18 * HOUR, ignore_failed, slices=2, **settings)

    got = rows(T.results(closed(spark, make, case)), "scope", "pod", "since_us", "at_us")
    assert got == rows(batch, "scope", "pod", "since_us", "at_us") and got


def polled(events, delay="0 seconds", closing=None, ignore_failed=True):
    made = listings(events)
    polls = made.select("scope", "poll_seq", "ts", "poll_ok")
    return T.sustained_condition_polls(
        polls, made, ["scope"], ["pod"], 18 * HOUR, ignore_failed, slices=2, delay=delay, closing=closing
    )


def lasting(events, ignore_failed=True):
    """The batch form over the same listings, a poll being at the earliest of its times."""
    table = listings(events)
    polls = table.groupBy("scope", "poll_seq").agg(F.min("ts").alias("ts"), F.first("poll_ok").alias("poll_ok"))
    obs = P.poll_observations(polls, table.select("scope", "poll_seq", "pod"), ["scope"], ["pod"], ignore_failed)
    return P.sustained_condition(obs, ["scope", "pod"], 18 * HOUR)


def test_repeated_polls_and_sightings_do_not_add_to_state(spark, tmp_path, progress):
    """A hundred rows for one: what is held grows with slices and buckets, not with the rows of a micro-batch."""
    events = spark.read.parquet(EVENTS)
    later = (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("copy") / 1000)).cast(events.schema["ts"].dataType)
    many = events.crossJoin(spark.range(100).withColumnRenamed("id", "copy")).withColumn("ts", later)
    folder = write_files(spark, [many.select(*events.columns)], tmp_path)
    out = T.results(closed(spark, polled, (folder, "60 days")))
    columns = "scope", "pod", "since_us", "at_us"
    assert rows(out, *columns) == rows(lasting(many), *columns) and out.count()
    held = max(p["stateOperators"][0]["numRowsTotal"] for run in progress for p in run if p["stateOperators"])
    spans = events.select(F.floor(micros(events, "ts") / (18 * HOUR * MICROS))).distinct().count()
    # a lot of polls and sightings and its timer for each of two scopes, two slices and the spans
    assert held <= 2 * 2 * 2 * spans + 8


def test_scopes_and_keys_without_a_value_are_apart(spark, tmp_path):
    """Rows of a scope that is null leave the rows of others where they are."""
    events = spark.read.parquet(EVENTS)
    nulled = events.withColumn("user_id", F.when(F.col("event_id") % 7 > 0, F.col("user_id")))
    folder = write_files(spark, [nulled], tmp_path)
    got = rows(T.results(closed(spark, polled, (folder, "60 days"))), "scope", "pod", "since_us", "at_us")
    assert [r for r in got if r[0] is not None] == rows(lasting(nulled), "scope", "pod", "since_us", "at_us")
    # as a scope with a number has it, whose only key also has one
    named = nulled.where("user_id is null").withColumn("user_id", F.lit(0).cast("bigint"))
    alone = rows(lasting(named), "since_us", "at_us")
    assert [r for r in got if r[0] is None] == [(None, None, *r) for r in alone] and alone


def test_late_polls_and_sightings_are_given_out_row_by_row(spark, landed, tmp_path):
    """The second file goes last; its rows are late for each slice they are for, none is lost in a pack."""
    paths = [Path(landed) / f"{i}.parquet" for i in (0, 2, 3, 1)]
    parts = [spark.read.parquet(str(p)) for p in paths]
    out = closed(spark, polled, (write_files(spark, parts, tmp_path), "0 seconds"))
    listed = listings(parts[3]).select("scope", "pod", micros(parts[3], "ts").alias("at"))
    want = [(r["scope"], pod, r["at"]) for r in listed.collect() for pod in (None, None, r["pod"])]
    assert rows(out.where(f"{T.LATE} is not null"), "scope", "pod", T.LATE) == sorted(want, key=repr)
    in_time = parts[0].unionByName(parts[1]).unionByName(parts[2])
    columns = "scope", "pod", "since_us", "at_us"
    assert rows(T.results(out), *columns) == rows(lasting(in_time), *columns)


def test_late_rows_are_given_out_and_counted(spark, landed, tmp_path):
    """The second file goes last, when the watermark has long passed its rows."""
    paths = [Path(landed) / f"{i}.parquet" for i in (0, 2, 3, 1)]
    parts = [spark.read.parquet(str(p)) for p in paths]
    folder = write_files(spark, parts, tmp_path)
    out = closed(spark, throttled, (folder, "0 seconds"))
    assert T.late(out, []).first()["n_late"] == parts[3].count()
    assert sorted(r["event_id"] for r in out.where(f"{T.LATE} is not null").collect()) == sorted(
        r["event_id"] for r in parts[3].collect()
    )
    in_time = parts[0].unionByName(parts[1]).unionByName(parts[2])
    batch = P.throttle_per_key(in_time, ["user_id"], 12 * HOUR, order=["event_id"])
    assert rows(T.results(out), "user_id", "at_us", "event_id") == rows(batch, "user_id", "at_us", "event_id")


def test_first_seen(spark, landed):
    def named(events):
        return events.select(F.concat("event_type", F.lit("-"), "user_id").alias("name"), F.col("ts").cast("timestamp").alias("ts"))

    want = rows(P.first_seen_follow(named(spark.read.parquet(EVENTS)), "error-"), "name")
    out = T.first_seen_follow(named(stream(spark, landed)), "error-").select("name")
    assert rows(T.run_to_end(spark, out, "t"), "name") == want
    bounded = T.first_seen_follow(named(stream(spark, landed)), "error-", within="100 days").select("name")
    assert rows(T.run_to_end(spark, bounded, "t"), "name") == want


def test_a_key_that_comes_back_is_not_new(spark, tmp_path):
    """Four files, the latest first; the third micro-batch is repeated as after a failure. No state is kept."""
    seen = [(f"pod-{i % 7}" if i % 2 else f"pod-{i}", 21_600 * day + i) for day in range(20) for i in range(30)]
    data = spark.createDataFrame([*seen, ("other-1", 5)], "name string, s long")
    data = data.select("name", F.timestamp_seconds("s").alias("ts"))
    part = 3 - F.floor(F.unix_seconds("ts") / 108_000)
    (tmp_path / "in").mkdir()
    folder, path = write_files(spark, [data.where(part == i) for i in range(4)], tmp_path / "in"), str(tmp_path / "sink")
    session = T.stream_session(spark, 2)

    def run(files):
        source = session.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", files)
        query = T.first_seen_once(source.parquet(folder), "pod-", path).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    run("[012].parquet")
    for done in (tmp_path / "sink" / "checkpoint" / "commits").glob("*2*"):
        done.unlink()
    query = run("?.parquet")
    got = rows(T.first_seen_known(spark, path), "name")
    assert got == sorted({(name,) for name, _ in seen}, key=repr)
    assert not query.lastProgress["stateOperators"]


def test_redaction(spark, landed):
    def lines(events):
        return events.select("event_id", F.concat(F.lit("key="), F.md5(F.col("event_id").cast("string")), F.lit(" x")).alias("text"))

    out = T.run_to_end(spark, redact_text(lines(stream(spark, landed))), "t")
    assert rows(out, "event_id", "text") == rows(redact_text(lines(spark.read.parquet(EVENTS))), "event_id", "text")
    assert {r[0] for r in rows(out, "text")} == {"key=[redacted] x"}


def test_a_stream_goes_on_from_its_checkpoint(spark, landed, tmp_path):
    """Three runs over one checkpoint: state of the first is there in the others."""
    session = T.stream_session(spark, 2)
    times = session.range(0).select(F.timestamp_micros("id").alias("event_time"))
    times.write.parquet(str(tmp_path / "times"))

    def run(files):
        source = session.readStream.schema(spark.read.parquet(EVENTS).schema).option("maxFilesPerTrigger", 1)
        closing = session.readStream.schema(times.schema).parquet(str(tmp_path / "times"))
        T._run(sustained(source.option("pathGlobFilter", files).parquet(landed), closing=closing), str(tmp_path))

    run("[01].parquet")
    run("?.parquet")
    end = session.range(1).select(F.timestamp_micros(F.lit(until(spark))).alias("event_time"))
    end.write.mode("append").parquet(str(tmp_path / "times"))
    run("?.parquet")
    batch = P.sustained_condition(errors_of_users(spark.read.parquet(EVENTS)), ["user_id"], 12 * HOUR, order=["event_id"])
    got = T.results(spark.read.parquet(str(tmp_path / "out")))
    assert rows(got, "user_id", "at_us", "event_id") == rows(batch, "user_id", "at_us", "event_id")


def test_streams_run_from_any_folder(tmp_path):
    """The process beside the driver that starts a stateful stream finds the package too."""
    root = Path(__file__).resolve().parents[1]
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "import __spark_entry__ as entry\n"
        "from invq.session import local_session\n"
        "spark = local_session('2', 2)\n"
        "print('rows', entry.queries()['throttle_per_key_stream'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 479" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("name", ["redact_text_stream", "first_seen_follow_stream"])
def test_tables_of_several_files_are_read_whole(spark, tmp_path, name):
    from invq.plans import registry

    for table in ("events", "documents"):
        whole = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
        whole.repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    parts = registry.QUERIES[name](spark, str(tmp_path)).count()
    assert parts == registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_a_key_with_many_rows_is_decided_as_one_with_few(spark, mixed, monkeypatch, tmp_path):
    """What does not fit into the value of a key lies by buckets; rows without a time are passed over."""
    from invq.streaming.processors import ThrottleProcessor

    class Full(ThrottleProcessor):
        FEW = 3

    monkeypatch.setattr(T, "ThrottleProcessor", Full)
    Full.__module__ = "__main__"  # sent by value, as the workers do not have this file
    one = spark.read.parquet(EVENTS).withColumn("user_id", F.col("user_id") % 2)
    batch = P.throttle_per_key(one, ["user_id"], 12 * HOUR, order=["event_id"])

    def make(events, **settings):
        nulled = events.unionByName(events.withColumn("ts", F.lit(None).cast(events.schema["ts"].dataType)))
        return throttled(nulled.withColumn("user_id", F.col("user_id") % 2), **settings)

    out = T.results(closed(spark, make, (mixed, "60 days"), days=1))
    assert rows(out, "user_id", "at_us", "event_id") == rows(batch, "user_id", "at_us", "event_id")
