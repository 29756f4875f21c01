"""Every registered query with SQL, side by side with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from dossia.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


def plain(row):
    out = []
    for x in row:
        if x is None or isinstance(x, float) and math.isnan(x):
            out.append("-")
        elif isinstance(x, (bool, int, str)):
            out.append(str(x))
        else:
            out.append(f"{float(x):.6g}" if hasattr(x, "__float__") else str(x))
    return tuple(out)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    numbers = {f.name for f in got.schema if f.dataType.typeName() in ("double", "float")}
    want = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    cast = lambda c, x: float(x) if c in numbers and x is not None else x
    theirs = sorted(plain(cast(c, r[names.index(c)]) for c in columns) for r in want.fetchall())
    ours = sorted(plain(cast(c, x) for c, x in zip(columns, r)) for r in got.select(*columns).collect())
    assert ours == theirs
