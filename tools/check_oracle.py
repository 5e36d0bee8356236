"""Run registered queries in Spark and in DuckDB on the same tables and compare row counts, types and values.

    python tools/check_oracle.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from earmark.plans.registry import load_all  # noqa: E402
from earmark.session import build_session  # noqa: E402


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "is_integer") or isinstance(value, int):
        number = float(value)
        return repr(number + 0.0 if abs(number) < 1e15 else number)
    return str(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "int", "int": "int", "smallint": "int", "double": "float", "string": "text", "boolean": "bool",
         "INTEGER": "int", "BIGINT": "int", "DOUBLE": "float", "VARCHAR": "text", "BOOLEAN": "bool"}


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/{args.sf}"
    spark = build_session("check", "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    bad = 0
    for name, q in load_all().items():
        if args.names and name not in args.names:
            continue
        started = time.time()
        try:
            df = q.run(spark, folder)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - started
            if q.sql is None:
                print(f"rows  {name:40s} {len(got):7d} rows {took:6.2f}s  (no SQL)", flush=True)
                continue
            started = time.time()
            cursor = db.execute(q.sql)
            columns = [d[0] for d in cursor.description]
            want = cursor.fetchall()
            oracle_took = time.time() - started
            types = {c[0]: str(c[1]).upper() for c in db.execute(f"DESCRIBE {q.sql}").fetchall()}
            problems = []
            if sorted(columns) != sorted(df.columns):
                problems.append(f"columns {sorted(df.columns)} / {sorted(columns)}")
            else:
                for c, kind in df.dtypes:
                    if KINDS.get(kind) != KINDS.get(types[c]) or kind not in KINDS:
                        problems.append(f"type of {c}: {kind} / {types[c]}")
                a, b = rows_of(df.columns, got), rows_of(columns, want)
                if len(a) != len(b):
                    problems.append(f"rows {len(a)} / {len(b)}")
                if a != b:
                    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
                    problems.append(f"values: {len(set(a) - set(b))} differ\n      spark  {only_a}\n      duckdb {only_b}")
            bad += bool(problems)
            state = "FAIL " if problems else "ok   "
            print(f"{state} {name:40s} {len(got):7d} rows {took:6.2f}s  duckdb {oracle_took:5.2f}s {'; '.join(problems)[:1500]}", flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(exc).__name__}: {str(exc)[:1200]}", flush=True)
    print("all equal" if not bad else f"{bad} with problems")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
