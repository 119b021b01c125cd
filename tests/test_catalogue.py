"""Every catalogue query with an oracle is held against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from evalloom.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(int(x))
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x) + 0.0:.6g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    ours = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    theirs = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert ours == theirs


def test_flagship(spark):
    rows = catalogue.flagship(spark, str(DATA)).collect()
    assert rows and all(r["ap_lo"] is None or r["ap_lo"] <= r["ap_hi"] for r in rows)
