"""Every query against its SQL, at the smallest size."""

import datetime

import duckdb
import pytest

from trailframe.plans import catalog
from trailframe.plans import models as _models  # noqa: F401
from trailframe.plans import rules as _rules  # noqa: F401  (adds its queries to the catalog)
from trailframe.plans import tables as _tables  # noqa: F401
from trailframe.plans import videos as _videos  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v if v is None or isinstance(v, (bool, int, str)) else plain(float(v))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got


def test_without_text_operators():
    import __spark_entry__ as e

    assert "encounters" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
