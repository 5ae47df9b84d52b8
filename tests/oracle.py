"""Row-set comparison of a Spark query with DuckDB over the same Parquet tables."""

import glob
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql, sf_dir):
    found = duck(sf_dir).execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want, got = normal(found.fetchall(), names), normal([tuple(r) for r in df.collect()], df.columns)
    assert len(want) == len(got), (len(want), len(got))
    assert want == got
    return len(got)
