"""Every registered query of the library against its SQL, on the small tables."""

from pathlib import Path

import duckdb
import pytest

from docsluice import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(rows):
    return sorted(repr([round(x, 6) if isinstance(x, float) else None if x is None else str(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    wanted = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert plain(map(tuple, found.select(*[f"`{n}`" for n in names]).collect())) == plain(wanted.fetchall())


def test_flagship_rows(spark):
    assert catalog.flagship(spark, DATA).count() > 0
