"""Compare named queries with their DuckDB text: python tests/compare.py [sf_dir] [NAME ...]."""

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or isinstance(v, bool):
            return v
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
        return str(v)

    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in data)


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(sf)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf}/{name}{'/*.parquet' if os.path.isdir(f'{sf}/{name}') else ''}'")
    return con


def compare(spark, con, sf, name, make, sql):
    df = make(spark, sf)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    b = rows([d[0] for d in res.description], res.fetchall())
    return a, b


if __name__ == "__main__":
    import __spark_entry__ as e
    from strataform.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con, sqls, qs = local_session(8), duck(sf), e.oracle_sql(), e.queries()
    bad = 0
    for name in args or [n for n in qs if not n.startswith("op") and n != "pipeline"]:
        began = time.time()
        try:
            if name not in sqls:
                print(f"{name}: {qs[name](spark, sf).count()} rows, no SQL, {time.time() - began:.1f} s", flush=True)
                continue
            a, b = compare(spark, con, sf, name, qs[name], sqls[name])
            if a == b:
                print(f"{name}: ok, {sum(a[1].values())} rows, {time.time() - began:.1f} s", flush=True)
            else:
                bad += 1
                print(f"{name}: DIFFERS {a[0]} {b[0]} {sum(a[1].values())} {sum(b[1].values())}\n  only here {list((a[1] - b[1]).items())[:3]}\n  only there {list((b[1] - a[1]).items())[:3]}", flush=True)
        except Exception as x:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {str(x)[:600]}", flush=True)
        spark.catalog.clearCache()
    sys.exit(bad > 0)
