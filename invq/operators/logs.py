"""Log and text questions: redaction, leak counts, probe outcomes, tokens.

All of these are projections over whole texts, followed at most by one aggregation with partial
combine, so they scale with the scan. `redact_text` and `log_route_filter` also run on streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDACTED = "[redacted]"

# fixed values: the credential shapes, in the order they are tried at each position
SECRET_SHAPES = {
    "service_key": r"pcsk_[A-Za-z0-9_]{8,}",
    "stack_token": r"pul-[0-9a-f]{20,}",
    "access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "signed_token": r"ey[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
    "database_url": r"postgres(?:ql)?://[^\s:/]+:[^\s@]+@",
    "hex_key": r"\b[0-9a-f]{32}\b",
}

#: What any text with a shape in it has, asked without Unicode rules and without the shape's tail. The shapes
#: themselves are only looked for where this is there.
SECRET_SIGNS = {
    "service_key": ("pcsk_",),
    "stack_token": ("pul-",),
    "access_key": ("AKIA", "ASIA"),
    "signed_token": r"ey[A-Za-z0-9_-]{10}",
    "database_url": ("postgres",),
    "hex_key": r"[0-9a-f]{32}",
}

# fixed values: the tokens read from log lines, and the answer of a probe that got none
CLUSTER_TOKEN = r"--name\s+(\S+)"
HOST_TOKEN = r"server:\s*https://([^:/\s]+)"
ATTEMPT = r"attempt \d+: (\d{3})"
NO_ANSWER = "000"

#: White space and word borders mean the Unicode kinds.
UNICODE = "(?U)"


def may_hold(text: Column, shape: str) -> Column:
    """Whether a text can have a shape in it, by plain search or a pattern without borders."""
    sign = SECRET_SIGNS[shape]
    if isinstance(sign, str):
        return text.rlike(sign)
    found = [F.contains(text, F.lit(literal)) for literal in sign]
    return found[0] if len(found) == 1 else found[0] | found[1]


def redacted(text: Column) -> Column:
    masked = F.regexp_replace(text, UNICODE + "|".join(SECRET_SHAPES.values()), REDACTED)
    may = F.lit(False)
    for shape in SECRET_SHAPES:
        may = may | may_hold(text, shape)
    return F.when(may, masked).otherwise(text)


def redact_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Masks every credential shape in a text column; works on batches and streams."""
    return df.withColumn(text, redacted(F.col(text)))


def secret_scan(df: DataFrame, source: Sequence[str], text: str = "text") -> DataFrame:
    """Hits per source and shape, zero included: which shape leaks where.

    Counted per row and summed per source first; only then are the six sums turned into rows.
    """
    counts = [
        F.sum(F.when(may_hold(F.col(text), name), F.regexp_count(F.col(text), F.lit(UNICODE + shape)))).cast("bigint").alias(name)
        for name, shape in SECRET_SHAPES.items()
    ]
    per_source = df.groupBy(*source).agg(*counts)
    return per_source.unpivot(list(source), list(SECRET_SHAPES), "shape", "n_hits").withColumn(
        "n_hits", F.coalesce("n_hits", F.lit(0).cast("bigint"))
    )


def probe_last_status(
    lines: DataFrame, probe: str = "probe_id", order: Sequence[str] = ("ts",), line: str = "line"
) -> DataFrame:
    """Per probe: the last status of an answered attempt, or null when none was answered."""
    codes = F.regexp_extract_all(F.col(line), F.lit(ATTEMPT), F.lit(1))
    answered = F.filter(codes, lambda code: code != NO_ANSWER)
    last = F.get(answered, F.size(answered) - 1)
    attempt = F.when(last.isNotNull(), F.struct(*order, F.col(line)))
    return lines.groupBy(probe).agg(F.max_by(last, attempt).cast("int").alias("status"))


def log_route_filter(
    lines: DataFrame, own: Sequence[str] = ("root",), logger: str = "logger", line: str = "line"
) -> DataFrame:
    """Records of our own loggers, redacted, with ``cluster`` and ``host`` where a line names them."""

    def token(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(F.col(line), pattern, 1), F.lit(""))

    return (
        lines.where(F.col(logger).isin(*own))
        .withColumn(line, redacted(F.col(line)))
        .withColumn("cluster", token(CLUSTER_TOKEN))
        .withColumn("host", token(HOST_TOKEN))
    )
