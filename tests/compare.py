"""Compares a query's rows with those of its SQL."""

import os

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return c


def canonical(rows, columns):
    def cell(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted(repr([cell(r[c]) for c in columns]) for r in rows)


def spark_rows(df):
    return [r.asDict() for r in df.collect()]


def sql_rows(c, sql):
    found = c.sql(sql)
    return [dict(zip(found.columns, r)) for r in found.fetchall()]
