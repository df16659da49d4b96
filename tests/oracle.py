"""Run registered queries in Spark and their SQL twins in DuckDB and compare the results.

    python -m tests.oracle [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from fnmatch import fnmatch


import duckdb
import pyarrow as pa

from stratiform.suite import TABLES, Tables, load


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, list):
        return [_cell(x) for x in v]
    return v


def _table(t: pa.Table):
    names = sorted(t.column_names)
    rows = list(zip(*[[_cell(v) for v in t[n].to_pylist()] for n in names]))
    types = {n: str(t.schema.field(n).type).replace("large_", "") for n in names}
    return names, types, sorted(rows, key=repr)


def compare(spark, con, folder: str, q) -> tuple[bool, str]:
    got = q.run(Tables(spark, folder)).toArrow()
    a = _table(got)
    if q.sql is None:
        return got.num_rows > 0, f"rows only: {got.num_rows}"
    want = con.sql(q.sql).to_arrow_table()
    b = _table(want)
    if a[0] != b[0]:
        return False, f"columns differ: {a[0]} / {b[0]}"
    if a[1] != b[1]:
        diff = {n: (a[1][n], b[1][n]) for n in a[0] if a[1][n] != b[1][n]}
        return False, f"types differ: {diff}"
    if a[2] != b[2]:
        left = [r for r in a[2] if r not in b[2]][:3] if len(a[2]) < 20000 else "..."
        right = [r for r in b[2] if r not in a[2]][:3] if len(a[2]) < 20000 else "..."
        return False, f"rows differ: {len(a[2])} / {len(b[2])}\n   spark {left}\n   sql   {right}"
    if not a[2]:
        return False, "both sides are empty"
    return True, f"{len(a[2])} rows"


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("names", nargs="*")
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    args = p.parse_args()
    from stratiform.session import build_session

    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                 "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name, q in load().items():
        if args.names and not any(fnmatch(name, n) for n in args.names):
            continue
        start = time.time()
        try:
            ok, text = compare(spark, con, args.sf, q)
        except Exception as e:  # noqa: BLE001
            ok, text = False, "".join(traceback.format_exception_only(e))[:900]
            if not args.names:
                text = text[:300]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} ({time.time() - start:.1f}s): {text}", flush=True)
    print(f"{bad} failing")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
