"""Compare registered queries with their SQL on the second engine.

    python -m tests.harness [sf dir] [name part ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def same(a, b, slack: float = 0.0) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if slack and isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= slack * max(1.0, abs(a))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return type(a) is type(b) and a == b
    return a == b


def compare(entry, spark, con, sf: str, slack: float = 0.0) -> str | None:
    """None when equal, else what differs. ``slack`` allows a last rounded digit (means of a few rows tie)."""
    df = entry.build(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if bad in plan:
            return f"plan has {bad}"
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if entry.sql is None:
        return None
    cursor = con.execute(entry.sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    key = lambda row: tuple((v is None, str(type(v).__name__), v if not isinstance(v, (float, int)) else round(v, 3), str(v)) for v in row)
    got.sort(key=lambda r: str(key(r)))
    want.sort(key=lambda r: str(key(r)))
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "empty"
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y, slack) for x, y in zip(g, w))]
    if bad:
        cols = sorted(df.columns)
        g, w = bad[0]
        diff = {c: (x, y) for c, x, y in zip(cols, g, w) if not same(x, y, slack)}
        return f"{len(bad)} of {len(got)} rows differ, first: {diff}"
    return None


def main() -> None:
    from plumeframe.catalog.registry import load
    from plumeframe.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = local_session(), connect(sf)
    failed = 0
    for name, entry in load().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            problem = compare(entry, spark, con, sf)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        flag = "ok " if problem is None else "BAD"
        print(f"{flag} {time.time() - start:6.2f}s {name}{'' if entry.sql else ' (rows only)'}{'' if problem is None else ' :: ' + problem}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
