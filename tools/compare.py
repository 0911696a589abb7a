"""Run registered Spark queries and their DuckDB oracles side by side.

usage: python tools/compare.py [sf_dir] [name-prefix ...]
Prints one line per query: status, rows, seconds, and the first difference.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quarry.plans.registry import load_all  # noqa: E402
from quarry.plans.tables import TABLES  # noqa: E402
from quarry.session import get_spark  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = get_spark("local[8]", shuffle_partitions=8)
    queries, oracles = load_all()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            srows = df.collect()
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"ERROR-SPARK {name}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        secs = time.time() - t0
        if name not in oracles:
            print(f"ROWS-ONLY {name}: rows={len(srows)} {secs:.1f}s cols={scols}")
            continue
        try:
            cur = con.execute(oracles[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR-SQL {name}: {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(ocols):
            print(f"SCHEMA {name}: spark={scols} sql={ocols}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(ocols, orows)
        if a == b:
            print(f"OK {name}: rows={len(a)} {secs:.1f}s")
        else:
            bad += 1
            diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
            print(f"MISMATCH {name}: rows spark={len(a)} sql={len(b)} cols={sorted(scols)} first diff={diff}")
    print(f"done, problems={bad}")


if __name__ == "__main__":
    main()
