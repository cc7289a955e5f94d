"""Comparison of a query with its SQL on the same parquet tables."""

import numbers

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _cell(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, numbers.Number) and not isinstance(v, bool):
        return int(v) if v == int(v) else round(float(v), 6)
    return str(v)


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(str([_cell(v) for v in row]) for row in frame.itertuples(index=False, name=None))
