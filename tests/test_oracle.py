"""Every query of the library beside its SQL in DuckDB: the same columns, the same rows."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from tracewell import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((plain([r[i] for i in order]) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted_rows(got.columns, got.collect()) == sorted_rows(columns, want.fetchall())
