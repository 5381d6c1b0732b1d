"""Runs a query and its SQL on the same tables and compares all values."""

import glob
import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def compare(df, sql: str, sf_dir: str) -> int:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    want = sorted((tuple(map(_plain, r)) for r in rel.select(*[f'"{n}"' for n in names]).fetchall()), key=repr)
    got = sorted((tuple(map(_plain, r)) for r in df.select(*names).collect()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, next((a, b) for a, b in zip(got, want) if a != b)
    return len(got)
