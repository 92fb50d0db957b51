import random

import pytest
from pyspark.sql import functions as F

from invq.operators import polling as P
from invq.plans.polling import HOUR, errors_of_users
from tests.helpers import rows

S = 1_000_000


def observe(spark, *steps, key="k"):
    """(second, present) observations of one key."""
    return spark.createDataFrame([(key, t * S, i, p) for i, (t, p) in enumerate(steps)], "key string, ts long, i int, present boolean")


def due(spark, *steps, **more):
    out = P.sustained_condition(observe(spark, *steps), ["key"], order=["i"], **more)
    return [(a // S, b // S) for a, b in rows(out, "since_us", "at_us")]


def test_a_reason_that_clears_inside_the_grace_is_never_due(spark):
    assert due(spark, (0, True), (20, False), (200, False)) == []


def test_a_reason_is_due_at_exactly_the_grace(spark):
    assert due(spark, (0, True), (119, True)) == []
    assert due(spark, (0, True), (120, True), (121, True)) == [(0, 120)]


def test_a_key_that_fails_again_is_timed_from_the_second_failure(spark):
    assert due(spark, (0, True), (30, False), (60, True), (150, True), (180, True)) == [(60, 180)]


def test_a_key_is_due_once(spark):
    assert due(spark, (0, True), (130, True), (140, False), (150, True), (400, True)) == [(0, 130)]


def brute_sustained(steps, grace):
    since = None
    for t, _, present in steps:
        if not present:
            since = None
            continue
        since = t if since is None else since
        if t - since >= grace:
            return since, t
    return None


@pytest.mark.parametrize(("seed", "stretch"), [(1, 7), (2, 50), (3, 1), (4, 10_000)])
def test_stretches_do_not_change_the_result(spark, seed, stretch):
    rng = random.Random(seed)
    data, want = [], {}
    for key in range(30):
        times = sorted(rng.sample(range(400), rng.randint(1, 120)))
        steps = [(t * S, i, rng.random() < 0.9) for i, t in enumerate(times)]
        data += [(key, *s) for s in steps]
        found = brute_sustained(steps, 60 * S)
        if found:
            want[key] = found
    rng.shuffle(data)
    df = spark.createDataFrame(data, "key int, ts long, i int, present boolean")
    out = P.sustained_condition(df, ["key"], 60, order=["i"], stretch_seconds=stretch)
    assert {r["key"]: (r["since_us"], r["at_us"]) for r in out.collect()} == want
    assert len(want) > 3


@pytest.mark.parametrize(("hours", "n"), [(1, 140), (12, 88), (24, 50)])
def test_known_counts(spark, hours, n):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    out = P.sustained_condition(errors_of_users(events), ["user_id"], hours * HOUR, order=["event_id"])
    assert out.count() == n


def polled(spark, ok, listed, **more):
    polls = spark.createDataFrame([("c", i, i * 60 * S, o) for i, o in enumerate(ok)], "cluster string, poll_seq int, ts long, poll_ok boolean")
    seen = spark.createDataFrame([("c", i, k) for i, k in listed], "cluster string, poll_seq int, reason string")
    obs = P.poll_observations(polls, seen, ["cluster"], ["reason"], **more)
    out = P.sustained_condition(obs, ["cluster", "reason"])
    return [(r, a // S, b // S) for r, a, b in rows(out, "reason", "since_us", "at_us")]


def test_a_poll_that_does_not_list_a_key_resets_it(spark):
    assert polled(spark, [True] * 3, [(0, "a"), (1, "a"), (2, "a")]) == [("a", 0, 120)]
    assert polled(spark, [True] * 4, [(0, "a"), (1, "a"), (3, "a")]) == []
    # another reason is another key
    assert polled(spark, [True] * 3, [(0, "a"), (1, "b"), (2, "a")]) == []


def test_a_failed_poll_resets_unless_it_is_ignored(spark):
    listed = [(0, "a"), (2, "a"), (3, "a")]
    assert polled(spark, [True, False, True, True], listed) == []
    assert polled(spark, [True, False, True, True], listed, ignore_failed=True) == [("a", 0, 120)]


def brute_throttle(times, interval):
    kept, last = [], None
    for t in times:
        if last is None or t - last >= interval:
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize(("seed", "per_stretch"), [(1, 1), (2, 3), (3, 16), (4, 2)])
def test_throttle_equals_a_loop(spark, seed, per_stretch):
    rng = random.Random(seed)
    data, want = [], []
    for key in range(12):
        times = sorted(rng.choices(range(rng.choice([50, 3000, 20_000])), k=rng.randint(1, 300)))
        data += [(key, t * S, i) for i, t in enumerate(times)]
        want += [(key, t * S) for t in brute_throttle(times, 300)]
    firsts = {}
    for key, t, i in data:
        firsts.setdefault((key, t), i)
    rng.shuffle(data)
    df = spark.createDataFrame(data, "key int, ts long, i int")
    out = P.throttle_per_key(df, ["key"], 300, order=["i"], intervals_per_stretch=per_stretch)
    assert rows(out, "key", "at_us", "i") == sorted([(k, t, firsts[k, t]) for k, t in want], key=repr)


def test_throttle_composes_a_bounded_number_of_tables(spark, monkeypatch):
    """One key over thousands of stretches, on both sides of time zero: the loop's rows, and no large group."""
    monkeypatch.setattr(P, "FAN_IN", 3)
    groups, plain = [], P.map_groups

    def counted(df, by, order, work, schema):
        if "parent" in by:
            groups.append(df.groupBy(*by).count().agg(F.max("count")).first()[0])
        return plain(df, by, order, work, schema)

    monkeypatch.setattr(P, "map_groups", counted)
    rng = random.Random(4)
    times = sorted(rng.choices(range(-400_000, 400_000), k=2500))
    df = spark.createDataFrame([(1, t * S, i) for i, t in enumerate(times)], "key int, ts long, i int")
    out = P.throttle_per_key(df, ["key"], 300, order=["i"], intervals_per_stretch=2)
    assert rows(out, "at_us") == sorted([(t * S,) for t in brute_throttle(times, 300)], key=repr)
    assert len(groups) > 8 and max(groups) <= 6


def test_first_sight(spark):
    df = spark.createDataFrame([("tool-a", 5), ("tool-a", 3), ("app", 1)], "name string, ts long")
    assert rows(P.first_seen_follow(df, "tool-"), "name", "at_us") == [("tool-a", 3)]


def attempts(spark, *data):
    return spark.createDataFrame(
        [(k, t * S, s, f) for k, t, s, f in data], "target string, ts long, status int, failure string"
    )


def test_reached_before_the_deadline(spark):
    df = attempts(
        spark,
        ("a", 0, None, "Timeout"), ("a", 899, 200, None),
        ("b", 0, 503, "answered 503"), ("b", 890, None, "Timeout"), ("b", 900, 200, None),
    )
    out = P.reached_within(df)
    assert rows(out, "target", "ok", "latency_us", "last_failure") == [("a", True, 899 * S, None), ("b", False, None, "Timeout")]
    starts = spark.createDataFrame([("a", 500 * S), ("c", 0)], "target string, start long")
    out = P.reached_within(df, starts=starts)
    assert rows(out, "target", "ok", "latency_us") == [("a", True, 399 * S), ("c", False, None)]


def test_any_answer_in_the_window_is_a_violation(spark):
    df = attempts(spark, ("a", 0, None, "x"), ("a", 179, 404, None), ("b", 0, None, "x"), ("b", 180, 200, None))
    assert rows(P.never_reached(df), "target", "passed", "after_us", "status") == [("a", False, 179 * S, 404), ("b", True, None, None)]


def test_job_outcomes(spark):
    data = [
        ("ok", 0, 0, 0, True), ("ok", 10, 1, 1, True), ("ok", 20, 0, 1, True),
        ("bad", 0, 0, 0, True), ("bad", 1790, 0, 1, True),
        ("gone", 0, 0, 0, True), ("gone", 10, None, None, False),
        ("late", 0, 0, 0, True), ("late", 1800, 1, 0, True),
        ("busy", 0, 0, 0, True), ("busy", 1799, 0, 0, True),
    ]
    df = spark.createDataFrame(
        [(j, t * S, s, f, x) for j, t, s, f, x in data], "job string, ts long, succeeded int, failed int, found boolean"
    )
    assert rows(P.job_outcome(df), "job", "outcome", "elapsed_us") == [
        ("bad", "failed", 1790 * S), ("busy", "running", None), ("gone", "gone", 10 * S), ("late", "timed_out", None), ("ok", "succeeded", 10 * S),
    ]


def test_verification(spark):
    data = [("a", 0, "pending"), ("a", 1, "verified"), ("a", 2, "failed"), ("b", 3, "failed"), ("c", 29, "pending"), ("c", 30, "verified"), ("d", 5, "x")]
    df = spark.createDataFrame(data, "service string, attempt int, state string")
    assert rows(P.verification_outcome(df), "service", "outcome") == [("a", "verified"), ("b", "failed"), ("c", "timed_out"), ("d", "pending")]


def test_only_stretches_of_a_key_meet_in_one_task(spark):
    """All windows over rows are per key and stretch of time; the one per key is over edges only."""
    df = observe(spark, (0, True), (1, True))
    plan = P.sustained_condition(df, ["key"])._jdf.queryExecution().optimizedPlan().toString()
    per_key = [line for line in plan.splitlines() if "Window" in line and "stretch" not in line.split("], [")[-2]]
    assert len(per_key) == 1
