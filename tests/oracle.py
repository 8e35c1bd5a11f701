"""Run registered queries against their oracles in DuckDB: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import threading
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    import decimal

    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols: list[str], rows) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    from plotline.plans import catalogue

    t = time.time()
    df = catalogue.QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    odd = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython") if w in plan]
    if odd:
        print(f"     plan of {name} has {odd}")
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    print(f"     spark {time.time() - t:.2f}s", end=" ", flush=True)
    sql = catalogue.ORACLES.get(name)
    if sql is None:
        return len(got) > 0, f"{len(got)} rows (no oracle)"
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    want = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    types = {c[0]: str(c[1]) for c in res.description}
    if got == want:
        big = [c for c, t in types.items() if t in ("HUGEINT", "DECIMAL")]
        return len(got) > 0, f"{len(got)} rows" + (f" wide types {big}" if big else "")
    bad = [(a, b) for a, b in zip(got, want) if a != b][:3]
    return False, f"{len(got)} vs {len(want)} rows; cols {sorted(cols)}; first differences {bad}"


def main() -> int:
    from plotline.plans import catalogue
    from plotline.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [n for n in catalogue.QUERIES if not args or any(n.startswith(a) for a in args)]
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    failed = 0
    limit = float(os.environ.get("ORACLE_SECONDS", "60"))
    for n in names:
        t = time.time()
        watch = threading.Timer(limit, lambda: (spark.sparkContext.cancelAllJobs(), con.interrupt()))
        watch.start()
        try:
            ok, text = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, text = False, f"{type(e).__name__}: {str(e)[:700]}"
        watch.cancel()
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:42s} {time.time() - t:6.2f}s {text}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
