"""One local session and one DuckDB connection for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, str(ROOT))

TESTDATA = Path(os.environ.get("TESTDATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from caseloom.session import build_session

    os.environ.setdefault("CASELOOM_DRIVER_MEMORY", "4g")
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(TESTDATA / "sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """A value as both engines print it."""
    import datetime
    import decimal
    import math

    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(plain, r)) for r in df.select(*names).collect())


def same_as_sql(df, con, sql):
    names, rows = rows_of(df)
    found = con.execute(sql)
    order = [c[0] for c in found.description]
    assert names == sorted(order)
    expected = sorted(tuple(plain(r[order.index(n)]) for n in names) for r in found.fetchall())
    assert rows == expected
