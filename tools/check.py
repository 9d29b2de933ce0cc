"""Run registered queries and compare them with their SQL in DuckDB.

usage: python tools/check.py [--sf 0.01] [--only name,name] [--covers G7]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from markgrid.catalog.registry import load, runner  # noqa: E402
from markgrid.catalog.tables import BASE  # noqa: E402
from markgrid.session import build_session  # noqa: E402


def plain(v):
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), [cols[i] for i in order]


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--module", default="")
    ap.add_argument("--plain", action="store_true", help="a session with default settings")
    a = ap.parse_args()
    d = f"/root/testdata/sf{a.sf}"
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").getOrCreate() if a.plain else build_session(cores="8")
    spark.sparkContext.setLogLevel("OFF")
    only = {x for x in a.only.split(",") if x}
    bad = 0
    for name, q in load().items():
        if only and name not in only:
            continue
        if a.module and not q.run.__module__.endswith(a.module):
            continue
        t0 = time.time()
        try:
            df = runner(q)(spark, d)
            got = df.collect()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR   {name}: {str(e)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if not q.sql:
            print(f"rows  {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            res = con.execute(q.sql)
            cols = [c[0] for c in res.description]
            want = res.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"SQLERR {name}: {str(e)[:900]}", flush=True)
            continue
        g, gc = rows(df.columns, got)
        w, wc = rows(cols, want)
        ok = g == w and gc == wc
        if ok and (bools := [c for c, t in df.dtypes if t == "decimal"]):
            print("decimal", bools)
        bad += not ok
        print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(g)} rows {t1 - t0:.1f}s sql {time.time() - t1:.1f}s", flush=True)
        if not len(g):
            print("      EMPTY RESULT")
        if not ok:
            print("   cols", gc, wc, "rows", len(g), len(w))
            sg, sw = set(map(repr, g)), set(map(repr, w))
            for r in [r for r in map(repr, g) if r not in sw][:4]:
                print("   spark", r[:400])
            for r in [r for r in map(repr, w) if r not in sg][:4]:
                print("   sql  ", r[:400])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
