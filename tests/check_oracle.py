"""Compare registered queries with their SQL on the same parquet tables.

    python tests/check_oracle.py [--sf 0.01] [name prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time
import traceback

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)

    def cell(v):
        if v is None or v is pd.NaT:
            return "∅"
        if isinstance(v, (float, np.floating)):
            if np.isnan(v):
                return "∅"
            return repr(float(v) + 0.0)
        if isinstance(v, (bool, np.bool_)):
            return repr(bool(v))
        if isinstance(v, (int, np.integer)):
            return repr(int(v))
        if isinstance(v, (pd.Timestamp, np.datetime64)):
            return pd.Timestamp(v).isoformat()
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if isinstance(v, (list, tuple, np.ndarray)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[cols].itertuples(index=False, name=None))


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)}/{len(a)} rows differ on {sorted(got.columns)}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return None


def frame(df) -> pd.DataFrame:
    rows = df.collect()
    return pd.DataFrame([list(r) for r in rows], columns=df.columns, dtype=object)


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    sf_dir = f"/root/testdata/sf{opts.sf}"
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(sf_dir), entry.oracle_sql(), []
    wanted = [n for n in entry.queries() if not opts.names or any(n == p or n.startswith(p) for p in opts.names)]
    for name in wanted:
        start = time.time()
        try:
            got = frame(entry.queries()[name](spark, sf_dir))
            took = time.time() - start
            if name in sqls:
                rel = con.execute(sqls[name])
                want = pd.DataFrame(rel.fetchall(), columns=[d[0] for d in rel.description], dtype=object)
                problem = compare(got, want)
            else:
                problem = None
            verdict = "rows-only" if name not in sqls else "ok" if problem is None else "DIFF"
            print(f"{verdict:9} {name:44} {len(got):7} rows {took:6.2f}s" + (f"\n   {problem}" if problem else ""), flush=True)
            if problem:
                failed.append(name)
        except Exception as exc:  # noqa: BLE001 - report and go on
            failed.append(name)
            print(f"ERROR     {name}: {str(exc)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(wanted)} queries, {len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
