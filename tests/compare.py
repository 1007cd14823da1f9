"""Rows of a Spark query and of DuckDB SQL over the same files, for comparison."""

import math
from pathlib import Path


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in records), key=repr)


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def both(spark, con, folder: str, query, sql: str):
    df = query(spark, folder)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return (sorted(df.columns), rows(df.columns, df.collect())), (sorted(names), rows(names, found.fetchall()))
