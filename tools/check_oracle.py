"""Run registered queries and their DuckDB oracle SQL side by side.

usage: python tools/check_oracle.py [sf_dir] [query ids...]
Prints one line per query: status, rows, and the first differing column.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from limnospark.plans import catalog  # noqa: E402
from limnospark.session import local_session  # noqa: E402
from limnospark.sources.tables import TABLES  # noqa: E402


def canon(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        return canon(v.item())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows_of(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(canon(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, qid, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    ts = time.time() - t0
    if sql is None:
        return f"{qid:24s} NOSQL rows={len(spdf)} spark={ts:.1f}s cols={list(spdf.columns)}"
    t1 = time.time()
    dpdf = con.execute(sql).df()
    td = time.time() - t1
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(dpdf)
    if sc != dc:
        return f"{qid:24s} COLS  spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return f"{qid:24s} COUNT spark={len(sr)} duck={len(dr)}"
    if sr != dr:
        for i, (a, b) in enumerate(zip(sr, dr)):
            if a != b:
                diff = [(c, x, y) for c, x, y in zip(sc, a, b) if x != y]
                return f"{qid:24s} VALUE rows={len(sr)} first diff row {i}: {diff[:3]}"
    return f"{qid:24s} OK    rows={len(sr)} spark={ts:.1f}s duck={td:.2f}s"


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    ids = [a for a in args if not a.startswith("/")]
    spark = local_session()
    con = duck(sf_dir)
    qs = catalog.queries()
    sqls = catalog.oracle_sql()
    for qid in ids or sorted(qs):
        try:
            print(compare(spark, con, qid, qs[qid], sqls.get(qid), sf_dir), flush=True)
        except Exception as e:  # report and continue
            msg = str(e).split("\n")[0][:300]
            print(f"{qid:24s} ERROR {type(e).__name__}: {msg}", flush=True)


if __name__ == "__main__":
    main()
