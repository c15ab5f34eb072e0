"""Run registered queries and their SQL side by side: python tests/oracle.py [sf_dir] [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(str, (plain(x) for x in v))) + "]"
    if type(v).__name__ == "ndarray":
        return plain(v.tolist())
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    if isinstance(v, (int, float)):
        return repr(float(v))
    if type(v).__name__ in ("datetime", "Timestamp", "date"):
        return str(v).replace("+00:00", "")
    return str(v)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def compare(spark, con, name, run, sql, sf_dir):
    t = time.time()
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return False, f"{name}: {len(rows)} rows, no SQL to compare with, {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} != {sorted(names)}"
    a, b = canonical(df.columns, rows), canonical(names, want)
    if a == b:
        return True, f"{name}: {len(a)} rows equal {took:.1f}s"
    only_a, only_b = [x for x in a if x not in b][:2], [x for x in b if x not in a][:2]
    return False, f"{name}: DIFF spark={len(a)} sql={len(b)} {sorted(names)}\n  spark {only_a}\n  sql   {only_b}"


if __name__ == "__main__":
    from earwitness.session import build_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    picked = sys.argv[2:]
    session = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, run in entry.queries().items():
        if picked and not any(name.startswith(p) for p in picked):
            continue
        if name not in entry.oracle_sql():
            print(f"none {name}", flush=True)
            continue
        try:
            ok, line = compare(session, con, name, run, entry.oracle_sql().get(name), sf)
        except Exception as e:  # noqa: BLE001
            ok, line = False, f"{name}: {type(e).__name__} {str(e)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + line, flush=True)
    print("failures:", bad)
