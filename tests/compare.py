"""Run registered queries beside their SQL in DuckDB and compare the results as bags of rows.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir: str, fn, sql: str | None):
    """(ok, message, seconds)"""
    t0 = time.time()
    df = fn(spark, sf_dir)
    data = df.collect()
    dt = time.time() - t0
    if sql is None:
        return True, f"{len(data)} rows, no SQL", dt
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    other = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} / {sorted(names)}", dt
    a, b = rows_of(df.columns, data), rows_of(names, other)
    if a == b:
        return True, f"{len(data)} rows", dt
    only_a, only_b = a - b, b - a
    return False, (f"{len(data)} / {len(other)} rows, {sum(only_a.values())} / {sum(only_b.values())} differ; columns "
                   f"{sorted(df.columns)}\n   spark {list(only_a)[:3]}\n   sql   {list(only_b)[:3]}"), dt


if __name__ == "__main__":
    import __spark_entry__ as entry
    from scintlake.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not (args and args[0].startswith("@") and qs[n].__module__.rsplit(".", 1)[-1] != args[0][1:])]
    args = [a for a in args if not a.startswith("@")]
    names = [n for n in names if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    session, con = local_session(), duck(sf)
    bad = 0
    for n in names:
        try:
            ok, msg, dt = compare(session, con, sf, qs[n], sqls.get(n))
        except Exception as e:  # report and go on
            ok, msg, dt = False, f"{type(e).__name__}: {str(e)[:700]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:28s} {dt:6.2f}s  {msg}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
