"""Compare each query with its SQL text in DuckDB: rows, columns and values."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.6g}" if abs(float(value)) < 1e15 else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir, queries, oracles):
    """Empty string if equal, else what differs."""
    df = queries[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return ""
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            bad = sum(x != y for x, y in zip(mine, theirs))
            return f"{bad} of {len(mine)} rows differ, e.g. {a} against {b}"
    return ""


def main() -> None:
    from tests.conftest import make_session

    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = make_session(), connect(sf_dir)
    for name in wanted or queries:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir, queries, oracles)
        except Exception as err:  # report and go on
            problem = f"{type(err).__name__}: {str(err)[:700]}"
        kind = "" if name in oracles else " (rows only)"
        print(f"{'FAIL' if problem else 'ok':4} {time.time() - start:6.2f}s {name}{kind} {problem}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
