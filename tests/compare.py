"""Compare a query with its SQL over the same Parquet files."""

import math
from pathlib import Path

import duckdb


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int):
        return f"{float(x):.9g}" if abs(x) < 2**53 else str(x)
    return str(x)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(sql, data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    done = con.execute(sql)
    names = [c[0] for c in done.description]
    return table(done.fetchall(), names)


def spark_rows(df):
    return table([tuple(r) for r in df.collect()], df.columns)
