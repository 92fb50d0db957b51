"""State exports parsed once, where they land: a VARIANT column that audits read paths from.

The text of an export stays behind. What is looked for anywhere in it, the account ids in resource names, is
taken out in the same pass and kept as a typed column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audit import ACCOUNT_IN_ARN


def parsed_exports(exports: DataFrame, export: str = "export") -> DataFrame:
    """The stack's columns, ``state`` (VARIANT, null where the text is no JSON), ``accounts`` and ``is_readable``."""
    rest = [c for c in exports.columns if c != export]
    state = F.try_parse_json(F.col(export))
    accounts = F.array_distinct(F.regexp_extract_all(F.col(export), F.lit(ACCOUNT_IN_ARN), F.lit(1)))
    return exports.select(*rest, state.alias("state"), accounts.alias("accounts"), state.isNotNull().alias("is_readable"))


def land_exports(exports: DataFrame, path: str, export: str = "export", mode: str = "errorifexists") -> None:
    """Writes `parsed_exports` as Parquet."""
    parsed_exports(exports, export).write.mode(mode).parquet(path)


def landed_resources(landed: DataFrame, network: str = "string") -> DataFrame:
    """One row per resource of landed exports: the stack's columns, type, urn and vpc_id (as ``network`` says)."""
    rest = [c for c in landed.columns if c not in ("state", "accounts", "is_readable")]
    listed = F.try_variant_get(F.col("state"), "$.deployment.resources", "array<variant>")
    return landed.select(*rest, F.explode(listed).alias("r")).select(
        *rest,
        F.try_variant_get("r", "$.type", "string").alias("type"),
        F.try_variant_get("r", "$.urn", "string").alias("urn"),
        F.try_variant_get("r", "$.outputs.vpcId", network).alias("vpc_id"),
    )


def landed_accounts(landed: DataFrame, stack: str = "stack") -> DataFrame:
    """The distinct account ids that the exports of each stack name, one row each."""
    return landed.select(stack, F.explode("accounts").alias("account")).distinct()
