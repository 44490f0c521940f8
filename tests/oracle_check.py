"""Compare registered queries with their SQL on one scale: ``python -m tests.oracle_check DIR [key ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return "NaN"
        return repr(float(v) + 0.0)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, key, query, sql):
    """Return a list of differences, the row count and the seconds the Spark side took."""
    start = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    seconds = time.time() - start
    columns, mine = rows_of(df.columns, got)
    if sql is None:
        return [], len(got), seconds
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs_columns, theirs = rows_of(names, cursor.fetchall())
    problems = []
    if columns != theirs_columns:
        problems.append(f"columns {columns} != {theirs_columns}")
    elif mine != theirs:
        problems.append(
            f"{sum(mine.values())} rows vs {sum(theirs.values())}; "
            f"only spark {list((mine - theirs).items())[:3]}; only sql {list((theirs - mine).items())[:3]}"
        )
    return problems, len(got), seconds


def main() -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from rangebreak.session import local_session

    sf_dir, keys = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = []
    for key in keys or queries:
        try:
            problems, n, seconds = compare(spark, con, sf_dir, key, queries[key], sql.get(key))
        except Exception as exc:  # report and go on to the next key
            problems, n, seconds = [f"{type(exc).__name__}: {str(exc)[:1500]}"], -1, 0.0
        mark = "FAIL" if problems else ("ok" if key in sql else "ok (rows only)")
        print(f"{key:28s} {mark:14s} {n:7d} rows {seconds:6.2f}s", flush=True)
        for problem in problems:
            print("    ", problem[:2500], flush=True)
            failed.append(key)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
