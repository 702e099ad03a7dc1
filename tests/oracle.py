"""Run a registered query on Spark and its SQL twin on DuckDB and compare all values.

    python tests/oracle.py [--sf 0.01] [KEY ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TIMES: dict[str, list[float]] = {}
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _norm(rows, order):
    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return (0, "")
        if isinstance(v, float):
            return (1, repr(v + 0.0 if v else 0.0))
        return (1, str(v))

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, key: str, query, sf_dir: str) -> tuple[str, int]:
    """Returns a problem text (empty when equal) and the row count."""
    from peakloom.plans.registry import spark_callable

    t0 = time.time()
    df = spark_callable(key)(spark, sf_dir)
    table = df.toArrow()
    t1 = time.time()
    TIMES[key] = [t1 - t0, 0.0]
    got = list(zip(*[c.to_pylist() for c in table.columns])) if table.num_rows else []
    if query.sql is None:
        return "", len(got)
    res = con.execute(query.sql)
    names = [d[0] for d in res.description]
    types = [TYPES.get(str(d[1]), str(d[1])) for d in res.description]
    t2 = time.time()
    want = res.fetchall()
    TIMES[key][1] = time.time() - t2
    s_types = dict(df.dtypes)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(got)
    bad = {n: (s_types[n], t) for n, t in zip(names, types) if s_types[n] != t}
    if bad:
        return f"types (spark, sql) {bad}", len(got)
    cols = sorted(names)
    a = _norm(got, [df.columns.index(c) for c in cols])
    b = _norm(want, [names.index(c) for c in cols])
    if a == b:
        return "", len(got)
    sa, sb = set(a), set(b)
    show = lambda s: [tuple(x[1] for x in t) for t in sorted(s)[:4]]
    return f"rows {len(a)} vs {len(b)}; cols {cols}; only spark {show(sa - sb)}; only sql {show(sb - sa)}", len(got)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("keys", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--from", dest="start", default=None)
    args = ap.parse_args()
    from peakloom.plans.catalog import REGISTRY
    from peakloom.session import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    keys = []
    for k in args.keys or list(REGISTRY):
        keys += [r for r in REGISTRY if r == k or (k.endswith("*") and r.startswith(k[:-1]))]
    failed = 0
    for key in keys:
        t = time.time()
        try:
            problem, n = compare(spark, con, key, REGISTRY[key], sf_dir)
        except Exception as e:  # noqa: BLE001
            tb = traceback.format_exc().splitlines()
            where = [x.strip() for x in tb if "peakloom/" in x][-1:]
            problem, n = f"{type(e).__name__}: {str(e)[:700]} {where}", -1
            con = connect(sf_dir)
        failed += bool(problem)
        kind = "sql" if REGISTRY[key].sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {key:7s} {kind} rows={n} all={time.time() - t:.1f}s spark={TIMES.get(key, [0])[0]:.1f}s {problem}", flush=True)
    print("failed:", failed, "of", len(keys))
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
