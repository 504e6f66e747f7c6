"""Comparing a query with its SQL twin on the smallest data folder."""

import collections
import glob
import os

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def rows_of(df):
    cols = sorted(df.columns)
    return cols, collections.Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())


def _plain(x):
    return round(x, 6) if isinstance(x, float) else str(x)


def rows_by_sql(sql):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), collections.Counter(tuple(_plain(r[i]) for i in order) for r in got.fetchall())
