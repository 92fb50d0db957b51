import json

from invq.operators import audit as A
from invq.sources import exports as E
from tests.helpers import rows


def export(resources):
    return json.dumps({"deployment": {"resources": resources}})


def landed(spark, tmp_path):
    arn = "arn:aws:iam::123456789012:role/y"
    texts = [
        (1, export([{"type": "t", "urn": "u", "outputs": {"vpcId": "v-1", "deep": [{"arn": arn}]}}, {"type": "s", "urn": "w"}])),
        (2, export([])),
        (3, "{ not json " + arn),
        (4, None),
        (5, json.dumps({"deployment": {}})),
    ]
    E.land_exports(spark.createDataFrame(texts, "stack int, export string"), str(tmp_path / "x"))
    return spark.read.parquet(str(tmp_path / "x"))


def test_resources_are_read_by_path(spark, tmp_path):
    made = landed(spark, tmp_path)
    assert rows(E.landed_resources(made), "stack", "type", "urn", "vpc_id") == [(1, "s", "w", None), (1, "t", "u", "v-1")]
    assert rows(made, "stack", "is_readable") == [(1, True), (2, True), (3, False), (4, False), (5, True)]


def test_accounts_are_found_anywhere(spark, tmp_path):
    accounts = E.landed_accounts(landed(spark, tmp_path))
    assert rows(accounts, "stack", "account") == [(1, "123456789012"), (3, "123456789012")]
    callers = spark.createDataFrame([(1, "123456789012"), (2, "1"), (3, "000000000001")], "stack int, caller string")
    assert rows(A.account_guard(accounts, callers), "stack", "violation") == [(1, False), (2, False), (3, True)]


def test_the_text_is_not_scanned(spark, tmp_path):
    made = E.landed_resources(landed(spark, tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema")[1]
    assert "variant" in read and "export" not in read and "accounts" not in read
