"""Run registered queries and their SQL side by side.

    python tests/compare.py [--sf 0.001] [name ...]
"""

from __future__ import annotations

import argparse
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("LITLAKE_TESTDATA", "/root/testdata")


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """One comparable form for the values both engines return."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], body


def run_sql(con, text):
    cur = con.execute(text)
    return table([d[0] for d in cur.description], cur.fetchall())


def run_spark(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def difference(spark_side, sql_side) -> str | None:
    (sc, sr), (qc, qr) = spark_side, sql_side
    if sc != qc:
        return f"columns differ: spark {sc} / sql {qc}"
    if len(sr) != len(qr):
        extra = next(iter(set(sr) - set(qr)), None)
        lost = next(iter(set(qr) - set(sr)), None)
        return f"rows differ: spark {len(sr)} / sql {len(qr)}\n spark only {extra}\n sql only {lost}"
    if sr != qr:
        wrong = [i for i in range(len(sr)) if sr[i] != qr[i]]
        a, b = set(sr) - set(qr), set(qr) - set(sr)
        return f"{len(wrong)} rows differ\n spark {next(iter(a), None)}\n sql   {next(iter(b), None)}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.001")
    parser.add_argument("--only-sql", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"{DATA}/sf{args.sf}"
    spark = make_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        if args.only_sql and name not in oracles:
            continue
        began = time.time()
        try:
            left = run_spark(queries[name](spark, sf_dir))
            took = time.time() - began
            problem = difference(left, run_sql(con, oracles[name])) if name in oracles else None
            verdict = "FAIL" if problem else "ok" if name in oracles else "rows"
            print(f"{verdict:5}{name:28}{len(left[1]):8} rows {took:6.2f}s", flush=True)
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
            print(f"ERROR {name}", flush=True)
        if problem:
            bad += 1
            print("   ", problem[:2500], flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
