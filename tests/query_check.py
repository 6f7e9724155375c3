"""Comparison of a query's rows with those of its SQL."""

import glob
import math
import os

import duckdb
import pytest

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def flat(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, dict):
        return tuple(flat(x) for x in v.values())
    if hasattr(v, "asDict"):
        return flat(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(flat(x) for x in v)
    return v


def connection():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def compare(spark, con, name, query, sql):
    df = query(spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(flat(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    head = ", ".join(f'"{c}"' for c in cols)
    want = sorted((tuple(flat(x) for x in r) for r in con.sql(f"select {head} from ({sql}) q").fetchall()), key=str)
    assert len(got) == len(want), name
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, (int, float)) for x in a) else str(a) == str(b) or a == b
