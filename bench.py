"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times (2) into a sink that takes every row and
keeps none; the median counts. The warm-up's row count is reported, and so is the plain predicate
form of the overlap join, on the same input, for comparison.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from invq.functions import cidr as C
from invq.operators import ranges as R
from invq.plans import ranges as range_plans
from invq.plans import registry
from invq.session import local_session

HEADLINE = (
    "range_policy_audit",
    "subnet_layout",
    "range_overlap",
    "range_overlap_free",
    "range_placement_verdict",
    "fleet_range_conflicts",
    "free_range_suggest",
    "range_collapse",
    "layout_integrity_audit",
    "table_egress_live",
    "zone_egress_live",
    "zone_egress_candidates",
    "quota_headroom",
    "requirement_gaps_by_zone",
    "common_zones",
    "preflight_rollup",
    "permission_verdicts",
    "foreign_account_guard",
    "resource_shape_audit",
    "state_diff",
    "layered_config",
    "keyvalue_flatten_tags",
    "retention_sweep_aws",
    "name_collision_audit",
    "redact_text",
    "secret_scan",
    "not_ready_pods",
    "baseline_new_keys",
    "reached_within",
    "sustained_condition",
    "throttle_per_key",
    "job_outcome",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(make) -> float:
    started = time.perf_counter()
    drain(make())
    return time.perf_counter() - started


def plain_overlap(spark, sf_dir):
    """The overlap as a predicate within a network, the way a nested loop asks it."""
    planned = R.subnet_layout(range_plans._wanted(spark, sf_dir)).select("vpc_id", "range_id", "subnet")
    theirs = range_plans._existing(spark, sf_dir).where("not is_ours")
    hit = (planned["vpc_id"] == theirs["vpc_id"]) & C.overlaps(planned["subnet"], theirs["net"])
    return planned.join(theirs, hit).select("range_id", "subnet_id")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    seconds, rows = {}, {}
    for name in HEADLINE:
        query = registry.QUERIES[name]
        seen = Observation()
        drain(query(spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("n")))
        rows[name] = seen.get["n"]
        seconds[name] = round(statistics.median(timed(lambda: query(spark, sf_dir)) for _ in range(RUNS)), 3)
    drain(plain_overlap(spark, sf_dir))
    plain = statistics.median(timed(lambda: plain_overlap(spark, sf_dir)) for _ in range(RUNS))
    print(
        json.dumps(
            {
                "metric": "total_seconds_of_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows": rows,
                "plain_overlap_sec": round(plain, 3),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
