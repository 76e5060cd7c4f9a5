"""Every query of the catalogue against its SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from fieldwright.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    return None if value is None or isinstance(value, float) and math.isnan(value) else f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    rows = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(rows.columns)
    mine = [tuple(map(plain, r)) for r in rows.select(*columns).collect()]
    cursor = duck.execute(catalogue.oracle_sql()[name])
    assert columns == sorted(d[0] for d in cursor.description)
    theirs = cursor.df()[columns].astype(object)
    theirs = [tuple(map(plain, r)) for r in theirs.where(theirs.notna(), None).itertuples(index=False)]
    assert len(mine) == len(theirs)
    key = lambda r: tuple((x is not None, x or "") for x in r)
    assert sorted(map(normal, mine), key=key) == sorted(map(normal, theirs), key=key)


def normal(row):
    """Numbers that pandas widened to floats compare as numbers."""
    out = []
    for x in row:
        try:
            out.append(f"{float(x):.9g}")
        except (TypeError, ValueError):
            out.append(x)
    return tuple(out)


def test_flagship_is_registered():
    assert catalogue.FLAGSHIP in catalogue.queries()
