"""Queries and checks for polled state, batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import polling as P
from .fixtures import fixture, oracle, supplied

HOUR = 3600
DAY = 24 * HOUR


def errors_of_users(events):
    return events.select(
        "user_id", "ts", "event_id", (F.col("event_type") == "error").alias("present")
    )


def sustained_condition(spark, sf_dir):
    obs = errors_of_users(supplied(spark, sf_dir, "events"))
    return P.sustained_condition(obs, ["user_id"], 12 * HOUR, order=["event_id"], stretch_seconds=DAY)


def _poll_form(spark, sf_dir, ignore_failed):
    polls, seen = fixture(spark, sf_dir, "poll"), fixture(spark, sf_dir, "poll_seen")
    obs = P.poll_observations(polls, seen, ["cluster"], ["user_id"], ignore_failed)
    return P.sustained_condition(obs, ["cluster", "user_id"], 3 * DAY, stretch_seconds=4 * DAY)


def sustained_condition_polls(spark, sf_dir):
    return _poll_form(spark, sf_dir, ignore_failed=False)


def sustained_condition_polls_ignore_failed(spark, sf_dir):
    return _poll_form(spark, sf_dir, ignore_failed=True)


def throttle_per_key(spark, sf_dir):
    events = supplied(spark, sf_dir, "events")
    return P.throttle_per_key(events, ["user_id"], 12 * HOUR, order=["event_id"])


def first_seen_follow(spark, sf_dir):
    return P.first_seen_follow(fixture(spark, sf_dir, "pod_sighting"), "tool-")


def _attempts(spark, sf_dir):
    return fixture(spark, sf_dir, "attempt")


def reached_within(spark, sf_dir):
    return P.reached_within(_attempts(spark, sf_dir), timeout_seconds=12 * HOUR, order=["event_id"])


def never_reached(spark, sf_dir):
    return P.never_reached(_attempts(spark, sf_dir), settle_seconds=6 * HOUR, order=["event_id"])


def job_outcome(spark, sf_dir):
    return P.job_outcome(fixture(spark, sf_dir, "job_poll"))


def verification_outcome(spark, sf_dir):
    return P.verification_outcome(fixture(spark, sf_dir, "verify_poll"))


QUERIES = {
    f.__name__: f
    for f in (
        sustained_condition,
        sustained_condition_polls,
        sustained_condition_polls_ignore_failed,
        throttle_per_key,
        first_seen_follow,
        reached_within,
        never_reached,
        job_outcome,
        verification_outcome,
    )
}


def sustained_sql(hours):
    return f"""
        with o as (select user_id, event_id, epoch_us(ts) as at_us, event_type = 'error' as bad,
                     sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id) as run
                   from events),
        b as (select *, min(at_us) over (partition by user_id, run) as since_us from o where bad)
        select user_id, since_us, at_us, event_id from b where at_us - since_us >= {hours * HOUR * 1_000_000}
        qualify row_number() over (partition by user_id order by at_us, event_id) = 1"""


def polls_sql(polls):
    return oracle(
        f"""with p as (select *, row_number() over (partition by cluster order by poll_seq) as nr from poll {polls}),
            o as (select s.cluster, s.user_id, p.nr, epoch_us(p.ts) as at_us,
                         p.nr - row_number() over (partition by s.cluster, s.user_id order by p.nr) as run
                  from poll_seen s join p on s.cluster = p.cluster and s.poll_seq = p.poll_seq and p.poll_ok),
            b as (select *, min(at_us) over (partition by cluster, user_id, run) as since_us from o)
            select cluster, user_id, since_us, min(at_us) as at_us from (
              select *, min(at_us) over (partition by cluster, user_id) as earliest from b
              where at_us - since_us >= {3 * DAY * 1_000_000}) d where at_us = earliest group by cluster, user_id, since_us""",
        "poll",
        "poll_seen",
    )


def throttle_sql(hours):
    gap = hours * HOUR * 1_000_000
    return f"""
        with recursive e as (select user_id, event_id, epoch_us(ts) as at_us from events),
        chain as (
          select user_id, min(at_us) as at_us from e group by user_id
          union all
          select c.user_id, min(e.at_us) from chain c join e on e.user_id = c.user_id and e.at_us >= c.at_us + {gap}
          group by c.user_id)
        select user_id, at_us, min(event_id) as event_id from chain join e using (user_id, at_us) group by user_id, at_us"""


ORACLES = {
    "sustained_condition": sustained_sql(12),
    "sustained_condition_polls": polls_sql(""),
    "sustained_condition_polls_ignore_failed": polls_sql("where poll_ok"),
    "throttle_per_key": throttle_sql(12),
    "first_seen_follow": oracle(
        "select name, min(epoch_us(ts)) as at_us from pod_sighting where starts_with(name, 'tool-') group by name",
        "pod_sighting",
    ),
    "reached_within": oracle(
        f"""with a as (select *, epoch_us(ts) - min(epoch_us(ts)) over (partition by target) as after_us from attempt),
            i as (select * from a where after_us < {12 * HOUR * 1_000_000}),
            s as (select target, min(after_us) filter (status = 200) as latency_us,
                         max_by(failure, (after_us, event_id)) filter (status is distinct from 200) as f from i group by target)
            select target, latency_us is not null as ok, latency_us, case when latency_us is null then f end as last_failure from s""",
        "attempt",
    ),
    "never_reached": oracle(
        f"""with a as (select *, epoch_us(ts) - min(epoch_us(ts)) over (partition by target) as after_us from attempt),
            s as (select target, min(after_us) filter (status is not null and after_us < {6 * HOUR * 1_000_000}) as first,
                         min_by(status, (after_us, event_id)) filter (status is not null) as st from a group by target)
            select target, first is null as passed, first as after_us, case when first is not null then st end as status from s""",
        "attempt",
    ),
    "job_outcome": oracle(
        """with p as (select *, epoch_us(ts) - min(epoch_us(ts)) over (partition by job) as elapsed_us from job_poll),
           t as (select job, elapsed_us, case when found and succeeded > 0 then 'succeeded' when found and failed > 0 then 'failed'
                   when not found then 'gone' end as o from p where elapsed_us < 1800000000),
           f as (select job, o, elapsed_us from t where o is not null qualify row_number() over (partition by job order by elapsed_us) = 1)
           select w.job, coalesce(o, case when watched >= 1800000000 then 'timed_out' else 'running' end) as outcome, elapsed_us
           from (select job, max(elapsed_us) as watched from p group by job) w left join f using (job)""",
        "job_poll",
    ),
    "verification_outcome": oracle(
        """with f as (select service, state from verify_poll where attempt < 30 and state in ('verified', 'failed')
                     qualify row_number() over (partition by service order by attempt) = 1)
           select service, coalesce(f.state, case when watched >= 29 then 'timed_out' else 'pending' end) as outcome
           from (select service, max(attempt) as watched from verify_poll group by service) w left join f using (service)""",
        "verify_poll",
    ),
}
