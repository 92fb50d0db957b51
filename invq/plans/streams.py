"""Queries that run the streaming forms over a supplied table to its end.

Nothing is known of how the table's files lie in time, so the stateful ones wait for as long as the
table spans, and are closed at its latest time. Their checks are those of the batch forms; where a deadline is
involved, a key without an outcome comes out only once event time has passed its deadline.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import MICROS, micros
from ..operators.logs import REDACTED, SECRET_SHAPES, redact_text
from ..session import scratch
from ..streaming import streams as T
from .fixtures import FIXTURES, oracle, spark_sql
from .polling import DAY, HOUR, errors_of_users, polls_sql, sustained_sql, throttle_sql

_JOB_TIMEOUT = 1800
#: Files that one micro-batch takes.
FILES = 64


def _source(session, sf_dir, table):
    """The stream of a table, which is one file or a folder of part files."""
    path = f"{sf_dir}/{table}.parquet"
    known = session.read.parquet(path)
    reader = session.readStream.schema(known.schema).option("maxFilesPerTrigger", FILES)
    files = known.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{table}.parquet"):  # streams read folders
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def _derived(session, sf_dir, name, table):
    """A derived table over the stream of the supplied table it is made from."""
    view = f"stream_of_{table}"
    _source(session, sf_dir, table).createOrReplaceTempView(view)
    return session.sql(spark_sql(FIXTURES[name].replace("{" + table + "}", view), sf_dir))


def _closed(spark, sf_dir, purpose, make, table="events"):
    """The results of make(session, settings) once event time has reached the end of the table."""
    session = T.stream_session(spark)
    whole = session.read.parquet(f"{sf_dir}/{table}.parquet")
    at = whole.select(micros(whole, "ts").alias("at")).agg(F.min("at"), F.max("at")).first()
    first, last = (x or 0 for x in at)
    seconds = (last - first) // MICROS + 1

    def stream(closing):
        return make(session, {"delay": f"{seconds} seconds", "closing": closing})

    return T.results(T.run_closed(spark, session, stream, purpose, last + seconds * MICROS + 1000))


def sustained_condition_stream(spark, sf_dir):
    def make(session, settings):
        obs = errors_of_users(_source(session, sf_dir, "events"))
        return T.sustained_condition(obs, ["user_id"], 12 * HOUR, order=["event_id"], **settings)

    return _closed(spark, sf_dir, "sustained", make)


def _polls_stream(spark, sf_dir, ignore_failed):
    def make(session, settings):
        events = _source(session, sf_dir, "events")
        day = F.year("ts") * 372 + F.month("ts") * 31 + F.day("ts")
        named = events.select((F.col("user_id") % 3).alias("cluster"), day.cast("bigint").alias("poll_seq"), "ts", "user_id")
        polls = named.select("cluster", "poll_seq", "ts", (F.col("poll_seq") % 10 != 4).alias("poll_ok"))
        return T.sustained_condition_polls(
            polls, named, ["cluster"], ["user_id"], 3 * DAY, ignore_failed, slices=4, **settings
        )

    return _closed(spark, sf_dir, "sustained-polls", make)


def sustained_condition_polls_stream(spark, sf_dir):
    return _polls_stream(spark, sf_dir, ignore_failed=False)


def sustained_condition_polls_ignore_failed_stream(spark, sf_dir):
    return _polls_stream(spark, sf_dir, ignore_failed=True)


def throttle_per_key_stream(spark, sf_dir):
    def make(session, settings):
        events = _source(session, sf_dir, "events")
        return T.throttle_per_key(events, ["user_id"], 12 * HOUR, order=["event_id"], **settings)

    return _closed(spark, sf_dir, "throttle", make)


def first_seen_follow_stream(spark, sf_dir):
    session = T.stream_session(spark)
    sighted = _derived(session, sf_dir, "pod_sighting", "events")
    out = T.first_seen_follow(sighted, "tool-")
    return T.run_to_end(spark, out.select("name"), "first-seen")


def first_seen_once_stream(spark, sf_dir):
    session, path = T.stream_session(spark), scratch(spark, "first-seen-once")
    sighted = _derived(session, sf_dir, "pod_sighting", "events")
    T.first_seen_once(sighted, "tool-", path).trigger(availableNow=True).start().awaitTermination()
    return T.first_seen_known(spark, path).select("name")


def redact_text_stream(spark, sf_dir):
    session = T.stream_session(spark)
    lines = _derived(session, sf_dir, "log_line", "events").withColumnRenamed("line", "text")
    out = T.run_to_end(spark, redact_text(lines), "redact")
    return out.select("id", "logger", "text")


#: No key of these tables begins anew.
_EVER = {"keep_seconds": 10_000 * DAY}


def reached_within_stream(spark, sf_dir):
    def make(session, settings):
        attempts = _derived(session, sf_dir, "attempt", "events")
        return T.reached_within(attempts, timeout_seconds=12 * HOUR, order=["event_id"], **settings, **_EVER)

    return _closed(spark, sf_dir, "reached", make)


def never_reached_stream(spark, sf_dir):
    def make(session, settings):
        attempts = _derived(session, sf_dir, "attempt", "events")
        return T.never_reached(attempts, settle_seconds=6 * HOUR, order=["event_id"], **settings, **_EVER)

    return _closed(spark, sf_dir, "never-reached", make).drop("detail")


def job_outcome_stream(spark, sf_dir):
    def make(session, settings):
        return T.job_outcome(_derived(session, sf_dir, "job_poll", "events"), **settings, **_EVER)

    return _closed(spark, sf_dir, "jobs", make).drop("detail")


QUERIES = {
    f.__name__: f
    for f in (
        sustained_condition_stream,
        sustained_condition_polls_stream,
        sustained_condition_polls_ignore_failed_stream,
        throttle_per_key_stream,
        first_seen_follow_stream,
        first_seen_once_stream,
        redact_text_stream,
        reached_within_stream,
        never_reached_stream,
        job_outcome_stream,
    )
}

def _deadline_sql(rows, key, outcome, timeout, overdue, detail="null"):
    micros = timeout * 1_000_000
    return f"""
        with a as (select *, {key} as k, epoch_us(ts) as t, min(epoch_us(ts)) over (partition by {key}) as start from {rows}),
        o as (select *, {outcome} as outcome from a where t < start + {micros}),
        f as (select k, outcome, t - start as elapsed_us from o where outcome is not null
              qualify row_number() over (partition by k order by t) = 1),
        d as (select k, max_by({detail}, t) as detail from o where outcome is null group by k),
        w as (select max(t) // 1000 as upto from a)
        select g.k as {key}, coalesce(outcome, '{overdue}') as outcome, elapsed_us,
               case when outcome is null then detail end as detail
        from (select distinct k, start from a) g left join f using (k) left join d using (k), w
        where outcome is not null or (start + {micros} + 999) // 1000 <= upto"""


def _without_detail(sql, key):
    return f"select {key}, outcome, elapsed_us from ({sql}\n) t"


_ENDED = """case when found and succeeded > 0 then 'succeeded' when found and failed > 0 then 'failed'
                when not found then 'gone' end"""

ORACLES = {
    "sustained_condition_stream": sustained_sql(12),
    "sustained_condition_polls_stream": polls_sql(""),
    "sustained_condition_polls_ignore_failed_stream": polls_sql("where poll_ok"),
    "throttle_per_key_stream": throttle_sql(12),
    "first_seen_follow_stream": oracle(
        "select distinct name from pod_sighting where starts_with(name, 'tool-')", "pod_sighting"
    ),
    "first_seen_once_stream": oracle(
        "select distinct name from pod_sighting where starts_with(name, 'tool-')", "pod_sighting"
    ),
    "redact_text_stream": oracle(
        f"""select id, logger, regexp_replace(line, '{"|".join(SECRET_SHAPES.values())}', '{REDACTED}', 'g') as text
            from log_line""",
        "log_line",
    ),
    "reached_within_stream": oracle(
        _deadline_sql("attempt", "target", "case when status = 200 then 'reached' end", 12 * HOUR, "unreached", "failure"),
        "attempt",
    ),
    "never_reached_stream": oracle(
        _without_detail(
            _deadline_sql("attempt", "target", "case when status is not null then 'answered' end", 6 * HOUR, "silent"),
            "target",
        ),
        "attempt",
    ),
    "job_outcome_stream": oracle(
        _without_detail(_deadline_sql("job_poll", "job", _ENDED, _JOB_TIMEOUT, "timed_out"), "job"),
        "job_poll",
    ),
}
