"""Run registered queries next to their SQL in DuckDB and compare whole results.

    python tools/check_queries.py [--sf DIR] [--only PREFIX ...] [--explain]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import importlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from patchwell.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:19]
    return str(v)


def kind(dtype) -> str:
    """Type class of a Spark or DuckDB column: whole number, number, text, flag or the type itself."""
    t = str(dtype).lower()
    for name, members in (("int", ("int", "integer", "bigint", "smallint", "tinyint", "ubigint")), ("float", ("double", "float")),
                          ("text", ("string", "varchar"))):
        if t in members:
            return name
    return t


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", nargs="*", default=[])
    ap.add_argument("--module", nargs="*", default=[])
    ap.add_argument("--explain", action="store_true")
    a = ap.parse_args()
    if a.module:
        books = [importlib.import_module(f"patchwell.plans.{m}").BOOK for m in a.module]
        queries = {k: v for b in books for k, v in b.queries.items()}
        sql = {k: v for b in books for k, v in b.sql.items()}
    else:
        from patchwell.plans import all_queries, all_sql
        queries, sql = all_queries(), all_sql()
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{a.sf}/{t}.parquet')")
    bad = 0
    for name, fn in queries.items():
        if a.only and not any(name.startswith(p) for p in a.only):
            continue
        start = time.time()
        try:
            df = fn(spark, a.sf)
            if a.explain:
                df.explain("formatted")
            got_names, got = canonical(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name not in sql:
            print(f"rows {name}: {len(got)} rows {took:.2f}s", flush=True)
            continue
        try:
            t0 = time.time()
            cur = con.execute(sql[name])
            want_types = {d[0]: kind(d[1]) for d in cur.description}
            want_names, want = canonical([d[0] for d in cur.description], cur.fetchall())
            sqlt = time.time() - t0
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"SQL  {name}: {str(e)[:900]}", flush=True)
            continue
        if got_names != want_names:
            bad += 1
            print(f"COLS {name}: {got_names} vs {want_names}", flush=True)
        elif {c: kind(t) for c, t in df.dtypes} != want_types:
            bad += 1
            print(f"TYPE {name}: {df.dtypes} vs {want_types}", flush=True)
        elif got != want:
            bad += 1
            in_got, in_want = set(got), set(want)
            only_a = [r for r in got if r not in in_want][:3]
            only_b = [r for r in want if r not in in_got][:3]
            print(f"DIFF {name}: {len(got)} vs {len(want)} rows {got_names}\n  spark {only_a}\n  sql   {only_b}", flush=True)
        else:
            print(f"ok   {name}: {len(got)} rows {took:.2f}s (sql {sqlt:.2f}s)", flush=True)
    print("problems:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
