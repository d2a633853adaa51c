"""Runs registered queries beside their SQL in DuckDB and compares all rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), [names[i] for i in order]


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    expected, wanted = rows(rel.columns, rel.fetchall())
    assert names == wanted, (names, wanted)
    assert len(got) == len(expected), (len(got), len(expected))
    differ = [(g, e) for g, e in zip(got, expected, strict=True) if g != e]
    assert not differ, differ[:2]
