"""Run registered queries on Spark and their DuckDB oracle SQL side by side.

usage: python tools/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, column match, value match, seconds.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from tessera.session import local_session
    from tessera.plans.registry import all_queries
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name, q in sorted(all_queries().items()):
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = q.build(spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.oracle is None:
            print(f"{name:28s} rows={len(srows):7d} (no oracle) {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            res = con.execute(q.oracle)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} DUCKDB ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        td = time.time() - t1
        colok = sorted(scols) == sorted(dcols)
        a = sorted(canon(scols, srows), key=repr)
        b = sorted(canon(dcols, drows), key=repr)
        valok = colok and a == b
        if not valok:
            bad += 1
        print(f"{name:28s} rows={len(srows):7d}/{len(drows):7d} cols={'ok' if colok else 'BAD'} "
              f"vals={'ok' if valok else 'BAD'} spark={ts:.1f}s duck={td:.1f}s")
        if not colok:
            print("   spark cols", scols, "\n   duck cols ", dcols)
        elif not valok:
            sa, sb = set(a), set(b)
            print("   only spark:", list(sa - sb)[:3])
            print("   only duck: ", list(sb - sa)[:3])
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
