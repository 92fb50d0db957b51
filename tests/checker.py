"""Runs registered queries against their SQL checks: python -m tests.checker [sf] [names...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else what differs; also the number of rows."""
    df = query(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(mine)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = _rows(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}", len(mine)
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return (
            f"{len(mine)} vs {len(theirs)} rows; only spark {sorted(a - b, key=repr)[:3]}; "
            f"only sql {sorted(b - a, key=repr)[:3]}"
        ), len(mine)
    return None, len(mine)


def main():
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from invq.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        started = time.time()
        try:
            problem, n = compare(spark, con, name, queries[name], sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            problem, n = f"{type(exc).__name__}: {str(exc)[:600]}", -1
        bad += problem is not None
        kind = "sql" if name in sqls else "rows only"
        print(f"{'FAIL' if problem else 'ok':4} {name} rows={n} {kind} {time.time() - started:.1f}s "
              f"{problem or ''}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
