"""A query's rows beside those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def compare(df, con, sql: str) -> tuple[list, list]:
    cols = sorted(df.columns)
    names = ", ".join(f'"{c}"' for c in cols)
    rel = con.sql(f"SELECT {names} FROM ({sql})")
    want = sorted((tuple(map(canon, r)) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(map(canon, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    return got, want
