"""Every query against its SQL twin on the smallest sample."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(TWINS[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    left = sorted(tuple(plain(v) for v in r) for r in got.select(*sorted(names)).collect())
    order = sorted(range(len(names)), key=lambda i: names[i])
    right = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert left == right


def test_entry(spark):
    assert entry.entry(spark).count() == 24


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)
