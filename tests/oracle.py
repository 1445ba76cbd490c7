"""Compares a query with its DuckDB SQL, as bags of rows with columns by name."""

import os

import duckdb


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(map(repr, (r[c] for c in cols))) for r in df.collect()), key=str), cols


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    return sorted((tuple(repr(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str), cols


def assert_same(df, sql, sf_dir):
    mine, cols = rows_of(df)
    theirs, names = oracle_rows(sql, sf_dir)
    assert cols == names
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, (a, b)
