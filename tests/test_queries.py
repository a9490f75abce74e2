from pathlib import Path

import pytest

from framequarry.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in found), key=repr)
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(want.select(*columns).fetchall())


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
