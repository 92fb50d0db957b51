"""What the entry point adds: the operators' queries and the pipeline's, with their SQL checks."""

from __future__ import annotations

import corpus_pipeline

from . import queries


def both() -> tuple[dict, dict]:
    checks = dict(queries.ORACLES)
    if corpus_pipeline.ORACLE_SQL is not None:
        checks["pipeline"] = corpus_pipeline.ORACLE_SQL
    return queries.QUERIES | {"pipeline": corpus_pipeline.run}, checks
