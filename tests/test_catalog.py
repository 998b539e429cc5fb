"""Every query of the catalogue against its DuckDB twin."""

import duckdb
import pytest
from conftest import SF

from threadloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted(repr(tuple(cell(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.SQL:
        assert len(got) > 0
        return
    want = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = want.fetchall()
    assert len(got) == len(rows)
    shape = lambda x: int(x) if isinstance(x, int) and not isinstance(x, bool) else x
    assert normal([[shape(v) for v in r] for r in got], df.columns) == normal([[shape(v) for v in r] for r in rows], want.columns)


@pytest.mark.parametrize("name", ["split_by_user", "sample_rows_hash", "gap_sessions", "dedupe_two_key"])
def test_order_of_rows_does_not_matter(name, spark, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(5).write.parquet(f"{tmp_path}/{t}.parquet")
    again = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, catalog.QUERIES[name](spark, SF).collect()))
