"""Compare registered queries with their SQL in DuckDB: ``check_queries.py [folder] [name part ...] [@module]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from larkspan.plans.catalog import QUERIES  # noqa: E402
from larkspan.plans.registry import TABLES  # noqa: E402
from larkspan.session import local_session  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    return v


def text(v):
    return f"{v:.5e}" if isinstance(v, float) else repr(v)


def compare(a_cols, a, b_cols, b):
    if sorted(a_cols) != sorted(b_cols):
        return f"columns {sorted(set(a_cols) ^ set(b_cols))}"
    order = sorted(a_cols)
    pick = lambda cols, rows: sorted(
        (tuple(plain(r[cols.index(c)]) for c in order) for r in rows), key=lambda r: [text(x) for x in r]
    )
    x, y = pick(a_cols, a), pick(b_cols, b)
    if len(x) != len(y):
        return f"rows {len(x)} != {len(y)}"
    exact, worst = 0, None
    for p, q in zip(x, y):
        if p == q and [type(v) for v in p] == [type(v) for v in q]:
            exact += 1
            continue
        for c, u, v in zip(order, p, q):
            same = u == v or (
                isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9)
            )
            if not same:
                return f"{c}: {u!r} != {v!r}  in {p} / {q}"
            if u != v or type(u) is not type(v):
                worst = (c, u, v)
    return None if exact == len(x) else f"NEAR {len(x) - exact} of {len(x)} {worst}"


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    module = next((p[1:] for p in parts if p.startswith("@")), None)
    parts = [p for p in parts if not p.startswith("@")]
    spark = local_session("check")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name, q in QUERIES.items():
        if (parts and not any(p in name for p in parts)) or (module and q.module != module):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - t0
            if q.sql is None:
                print(f"rows  {name} {len(rows)} rows {took:.1f}s {[plain(v) for v in rows[0]] if rows else ''}"[:300])
                continue
            t1 = time.time()
            cur = con.execute(q.sql)
            cols = [d[0] for d in cur.description]
            ref = cur.fetchall()
            message = compare(df.columns, rows, cols, ref)
            flag = "ok   " if message is None else "DIFF "
            bad += message is not None
            print(f"{flag} {name} {len(rows)} rows {took:.1f}s sql {time.time() - t1:.1f}s {message or ''}"[:600], flush=True)
        except Exception as e:  # keep going: the report is the point
            bad += 1
            print(f"ERROR {name} {type(e).__name__} {str(e)[:500]}", flush=True)
    print("problems:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
