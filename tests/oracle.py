"""Spark results against DuckDB over the same Parquet tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def differences(df, con, sql):
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    there = [d[0] for d in cur.description]
    assert sorted(there) == names
    want = sorted((tuple(plain(r[there.index(c)]) for c in names) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    return [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3]
