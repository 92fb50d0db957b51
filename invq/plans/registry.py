"""All registered queries and checks."""

from __future__ import annotations

import functools

from ..session import sized
from . import audit, capacity, egress, health, logs, polling, ranges, snapshots, streams

_MODULES = (ranges, logs, health, capacity, audit, egress, snapshots, polling, streams)


def _sized(query):
    """Runs a query with partitions for the size of its tables."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        return query(sized(spark, sf_dir), sf_dir)

    return run


QUERIES = {name: _sized(query) for module in _MODULES[:-1] for name, query in module.QUERIES.items()} | streams.QUERIES
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
