"""Queries and checks for the log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as L
from .fixtures import fixture, oracle


def redact_text(spark, sf_dir):
    out = L.redact_text(fixture(spark, sf_dir, "log_text"))
    return out.select("source", "id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


def secret_scan(spark, sf_dir):
    return L.secret_scan(fixture(spark, sf_dir, "log_text"), ["source"])


def probe_last_status(spark, sf_dir):
    return L.probe_last_status(fixture(spark, sf_dir, "probe_log"))


def log_route_filter(spark, sf_dir):
    out = L.log_route_filter(fixture(spark, sf_dir, "log_line"))
    return out.select("id", "line", "cluster", "host")


QUERIES = {f.__name__: f for f in (redact_text, secret_scan, probe_last_status, log_route_filter)}

_ANY = "|".join(L.SECRET_SHAPES.values())

ORACLES = {
    "redact_text": oracle(
        f"""with r as (select source, id, regexp_replace(text, '{_ANY}', '{L.REDACTED}', 'g') as t from log_text)
            select source, id, md5(t) as digest, length(t) as n_chars from r""",
        "log_text",
    ),
    "secret_scan": oracle(
        "with hits as ("
        + " union all ".join(
            f"select source, '{name}' as shape, len(regexp_extract_all(text, '{shape}')) as n from log_text"
            for name, shape in L.SECRET_SHAPES.items()
        )
        + ") select source, shape, cast(sum(n) as bigint) as n_hits from hits group by source, shape",
        "log_text",
    ),
    "probe_last_status": oracle(
        """with a as (select probe_id, ts, regexp_extract(line, 'attempt [0-9]+: ([0-9]{3})', 1) as code from probe_log)
           select probe_id, cast(max_by(code, ts) filter (code <> '000') as int) as status from a group by probe_id""",
        "probe_log",
    ),
    "log_route_filter": oracle(
        f"""select id, regexp_replace(line, '{_ANY}', '{L.REDACTED}', 'g') as line,
                  nullif(regexp_extract(line, '--name\\s+(\\S+)', 1), '') as cluster,
                  nullif(regexp_extract(line, 'server:\\s*https://([^:/\\s]+)', 1), '') as host
           from log_line where logger = 'root'""",
        "log_line",
    ),
}
