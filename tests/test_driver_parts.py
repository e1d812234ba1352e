"""Every part against its SQL."""

import os

import pytest

from tests.driver_parts import PARTS

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", PARTS)
def test_part(spark, name):
    import duckdb

    f, sql = PARTS[name]
    got = f(spark, DATA)
    con = duckdb.connect()
    for t in ("customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert want and sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))
