"""A Spark result against the oracle's, as the driver compares them: columns by name, rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    relation = con.sql(sql)
    return list(relation.columns), relation.fetchall()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf_dir: str) -> tuple[list, list]:
    names, rows = oracle(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    want, got = rows_of(names, rows), rows_of(df.columns, [tuple(r) for r in df.collect()])
    short = [] if len(got) == len(want) else [("rows", len(got), len(want))]
    return [r for r in got if r not in set(want)][:3] + short, [r for r in want if r not in set(got)][:3] + short
