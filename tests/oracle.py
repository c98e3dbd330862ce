"""Compares a query with its SQL in DuckDB."""

import decimal
import glob
import os

import duckdb
import numpy as np


def plain(v):
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        v = float(v)
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return int(v) if isinstance(v, (int, np.integer)) else v


def database(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())
    assert ours == theirs
