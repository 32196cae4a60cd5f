"""Compare every query with its oracle SQL: ``python -m workload.verify [sf_dir] [name regex]``."""
from __future__ import annotations

import datetime as dt
import math
import re
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(df, con, sql):
    """(difference or None, rows)."""
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}", 0
    if len(left[1]) != len(right[1]):
        missing = set(map(repr, right[1])) ^ set(map(repr, left[1]))
        return f"rows {len(left[1])} != {len(right[1])}; e.g. {sorted(missing)[:3]}", 0
    for a, b in zip(left[1], right[1]):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(left[0], a, b) if x != y]
            return f"spark/oracle differ in {bad[:4]} of row {a[:3]}", 0
    return None, len(left[1])


def main():
    from auditspan.session import local_session
    from workload import all_queries
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2] if len(sys.argv) > 2 else ""
    spark = local_session("verify")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = all_queries()
    bad = 0
    for name, fn in queries.items():
        if wanted and not re.search(wanted, name):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                diff, rows = compare(df, con, oracle[name])
                note = f"{rows} rows equal" if diff is None else diff
            else:
                diff, note = None, f"{df.count()} rows, no oracle"
        except Exception as exc:  # noqa: BLE001
            diff = note = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name} {time.time() - t:.1f}s {note[:900]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
