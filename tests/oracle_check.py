"""Run registered queries beside their oracle text: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from joulegrid.catalog import ORACLES, QUERIES  # noqa: E402
from joulegrid.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        column = frame[name]
        if str(column.dtype).startswith("datetime"):
            frame[name] = column.astype("datetime64[us]").astype(str)
        elif column.dtype.kind in "iuf" or str(column.dtype) in ("Int64", "Int32", "Float64"):
            frame[name] = column.astype(float)
        else:
            frame[name] = column.map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) else str(v))
    return frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def difference(spark_frame: pd.DataFrame, oracle_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(oracle_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(oracle_frame.columns)}"
    if len(spark_frame) != len(oracle_frame):
        return f"rows {len(spark_frame)} != {len(oracle_frame)}"
    a, b = normal(spark_frame), normal(oracle_frame)
    for name in a.columns:
        same = (a[name] == b[name]) | (a[name].isna() & b[name].isna())
        if not same.all():
            at = same.idxmin()
            return f"{name}: {(~same).sum()} rows differ, e.g.\n{a.loc[at].to_dict()}\n{b.loc[at].to_dict()}"
    if kinds(spark_frame) != kinds(oracle_frame):
        odd = {c: (k, kinds(oracle_frame)[c]) for c, k in kinds(spark_frame).items() if k != kinds(oracle_frame)[c]}
        return None if len(spark_frame) == 0 else f"types only: {odd}"
    return None


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    oracle = oracle_connection(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](session, sf).toPandas()
            middle = time.time()
            if name not in ORACLES:
                print(f"rows  {name}: {len(got)} rows, {middle - start:.1f}s", flush=True)
                continue
            found = difference(got, oracle.execute(ORACLES[name]).df())
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            found, middle = f"{type(error).__name__}: {str(error)[:1500]}", time.time()
            got = []
        bad += bool(found)
        print(f"{'FAIL ' if found else 'ok   '} {name}: {len(got)} rows, {middle - start:.1f}s, oracle {time.time() - middle:.1f}s" + (f"\n   {found}" if found else ""), flush=True)
    print("failures:", bad)
