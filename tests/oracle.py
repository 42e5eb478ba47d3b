"""Runs a query and its SQL on the same tables and compares the rows."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) and any(x.endswith(".parquet") for x in os.listdir(path)) else path
        c.sql(f"create view {t} as select * from '{files}'")
    return c


def _cell(x):
    if isinstance(x, (list, np.ndarray)):
        return str(list(x))
    if x is None or pd.isna(x):
        return "NULL"
    return repr(round(float(x), 6) + 0.0) if isinstance(x, (float, np.floating)) else str(x)


def rows(frame):
    return sorted(zip(*[[_cell(x) for x in frame[c]] for c in sorted(frame.columns)], strict=True))
