"""Every registered query of the engine against its SQL on DuckDB."""

import math

import duckdb
import pytest

from loomsheet.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float) and v == int(v):
        return int(v)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf):
    df = QUERIES[name](spark, sf)
    rows = [r.asDict() for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    found = duck.sql(SQL[name])
    names = sorted(found.columns)
    assert sorted(df.columns) == names
    key = lambda d: repr([plain(d[n]) for n in names])
    assert sorted(map(key, rows)) == sorted(key(dict(zip(found.columns, r, strict=True))) for r in found.fetchall())


def test_many_members_cover_keys_of_any_size(spark, tmp_path):
    keys = [-7, -6, 0, 1, 3, 14_999, 59_997, 60_000, 60_001, 90_000, 299_997, 300_000, None]
    spark.createDataFrame(list(enumerate(keys)), "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"] for r in QUERIES["filter_in_many"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert got == {r[0] for r in c.sql(SQL["filter_in_many"]).fetchall()} and len(got) == 8
