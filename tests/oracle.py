"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows(names, found) -> list[str]:
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in at]) for r in found)


def same(df, sql: str, sf_dir: str) -> None:
    c = connect(sf_dir).execute(sql)
    names = [x[0] for x in c.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, c.fetchall())
