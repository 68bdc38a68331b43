"""Every query against its SQL in DuckDB."""

import warnings
from pathlib import Path

import duckdb
import pytest

from binweave import catalog

warnings.simplefilter("ignore")
SF = Path("/root/testdata/sf0.001")
TABLES = [p.stem for p in SF.glob("*.parquet")]


def rows(frame):
    plain = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return sorted((tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(SF)).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(catalog.ORACLES) <= set(e.oracle_sql())
