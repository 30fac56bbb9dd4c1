"""Every query of the library against its SQL on the small tables."""

import duckdb
import pytest
from conftest import SMALL

from helixframe import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def _rows(rows):
    plain = lambda v: repr(v) if isinstance(v, (bool, str)) or v is None else repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else repr(v)
    return sorted(tuple(plain(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SMALL)
    cols = sorted(got.columns)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert _rows(tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()) == _rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_only(spark, name):
    assert catalogue.queries()[name](spark, SMALL).count() > 0
