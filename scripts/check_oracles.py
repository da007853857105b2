"""Run catalogue queries in Spark and their SQL in DuckDB, compare results.

usage: python scripts/check_oracles.py [sf_dir] [name ...]
Prints one line per query: rows, schema match, value match, seconds.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from affinity.session import build_session  # noqa: E402
from affinity.plans.catalog import REGISTRY  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records")]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or list(REGISTRY)
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in names:
        fn, sql = REGISTRY[name]
        t0 = time.time()
        try:
            sp = fn(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:22s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if sql is None:
            print(f"{name:22s} rows={len(sp):>9d} (no oracle) {ts:6.1f}s")
            continue
        try:
            dd = con.execute(sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:22s} SQL-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        cols_ok = sorted(sp.columns) == sorted(dd.columns)
        rows_ok = len(sp) == len(dd)
        vals_ok = cols_ok and rows_ok and _rows(sp) == _rows(dd)
        if not vals_ok:
            bad += 1
        print(f"{name:22s} rows={len(sp):>9d}/{len(dd):<9d} cols={'ok' if cols_ok else 'DIFF'} "
              f"vals={'ok' if vals_ok else 'DIFF'} {ts:6.1f}s")
        if not cols_ok:
            print("   spark:", list(sp.columns), "\n   sql:  ", list(dd.columns))
            print("   spark:", dict(sp.dtypes), "\n   sql:  ", dict(dd.dtypes))
        elif not vals_ok and rows_ok:
            a, b = _rows(sp), _rows(dd)
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print("   first diffs:", diff)
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
