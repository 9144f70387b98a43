"""Comparison of a query's rows with those of its DuckDB SQL, whatever their order."""

from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return ""
    return round(value, 6) if isinstance(value, float) else str(value)


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


def check(spark, query, sql):
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, expected = query(spark, DATA).toPandas(), connection.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
