"""What the plans must not contain, whatever the sizes."""

import pytest

from invq.plans import registry

SF = "/root/testdata/sf0.001"
BATCH = [n for n in registry.QUERIES if not n.endswith("_stream")]


PLANS = {}


def plan_of(spark, name):
    if name not in PLANS:
        df = registry.QUERIES[name](spark, SF)
        PLANS[name] = df._jdf.queryExecution().executedPlan().toString()
    return PLANS[name]


@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loops_and_no_cartesian_products(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", BATCH)
def test_no_window_over_everything(spark, name):
    """A window or an exchange without keys would put all rows into one task."""
    assert "SinglePartition" not in plan_of(spark, name)


@pytest.mark.parametrize("name", [n for n in BATCH if n != "throttle_per_key"])
def test_no_python_in_batch_plans(spark, name):
    plan = plan_of(spark, name)
    assert "Python" not in plan and "InPandas" not in plan


@pytest.mark.parametrize(
    ("name", "column", "unused"),
    [
        ("redact_text", "text", "n_chars"),
        ("sustained_condition", "event_type", "props"),
        ("retention_sweep_aws", "l_shipdate", "l_extendedprice"),
    ],
)
def test_scans_read_only_what_is_asked_for(spark, name, column, unused):
    schemas = [line for line in plan_of(spark, name).splitlines() if "ReadSchema" in line]
    assert any(column in line for line in schemas)
    assert not any(unused in line for line in schemas)


def test_filters_reach_the_scan(spark):
    plan = plan_of(spark, "exposure_audit")
    assert "PushedFilters: [Not(In(o_orderpriority, [1-URGENT,3-MEDIUM]" in plan
