"""Compare registered queries with their SQL oracles in DuckDB.

Run as a script: ``python -m tests.oracle [-s sf] [-b blockRows] [name ...]``.
"""

from __future__ import annotations

import argparse
import faulthandler
import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if value is pd.NaT:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item") and getattr(value, "ndim", 0) == 0:
        value = value.item()
        return _cell(value)
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, int):
        return value
    if hasattr(value, "tolist"):
        return tuple(_cell(v) for v in value.tolist())
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    columns = [[_cell(v) for v in frame[n].astype(object)] for n in names]
    return sorted(zip(*columns), key=repr) if columns else []


def kind(dtype) -> str:
    text = str(dtype)
    return "int" if "int" in text else "float" if "float" in text else "bool" if "bool" in text else "other"


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"row count {len(left)} != {len(right)}"
    a, b = rows(left), rows(right)
    differing = [(x, y) for x, y in zip(a, b) if x != y or repr(x) != repr(y)]
    if differing:
        return f"{len(differing)} of {len(a)} rows differ, first {differing[0]} (columns {sorted(left.columns)})"
    return "ok" if len(left) else "empty"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("-s", default="0.01")
    parser.add_argument("-b", default="")
    parser.add_argument("--slow", type=float, default=3.0)
    parser.add_argument("--limit", type=float, default=60.0)
    args = parser.parse_args()
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from stave.session import BLOCK_ROWS_CONF, build_session

    spark = build_session(
        "oracle", os.environ.get("ORACLE_MASTER", "local[8]"), **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    if args.b:
        spark.conf.set(BLOCK_ROWS_CONF, args.b)
    sf_dir = f"/root/testdata/sf{args.s}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    names = [n for n in queries if not args.names or any(n.startswith(p.rstrip("*")) if p.endswith("*") else n == p for p in args.names)]
    for name in names:
        faulthandler.dump_traceback_later(args.limit, exit=True)
        started = time.time()
        try:
            left = queries[name](spark, sf_dir).toPandas()
            spent = time.time() - started
            if name in oracles:
                started = time.time()
                right = connect(sf_dir).execute(oracles[name]).df()
                verdict = compare(left, right)
                note = f"{verdict} rows={len(left)} {spent:.1f}s/{time.time() - started:.1f}s"
            else:
                verdict, note = "ok", f"no oracle rows={len(left)} {spent:.1f}s"
        except Exception as error:  # noqa: BLE001
            verdict, note = "error", f"error {type(error).__name__}: {str(error)[:1500]}"
        if verdict != "ok":
            bad += 1
        print(("    " if verdict == "ok" else "!!! ") + f"{name}: {note}", flush=True)
    print(f"{len(names)} queries, {bad} not ok")


if __name__ == "__main__":
    main()
