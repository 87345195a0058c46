"""Comparison of a query with its SQL, as the driver does it: columns by name, rows in any order."""

import glob
import os

import duckdb


def connection(sf_dir: str):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else int(v) if hasattr(v, "as_tuple") else v
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    c = connection(sf_dir)
    cur = c.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return f"{len(mine[1])} and {len(theirs[1])} rows; only Spark: {sorted(a - b, key=str)[:3]}; only SQL: {sorted(b - a, key=str)[:3]}"
    return ""
