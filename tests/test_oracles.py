"""Every registered query with SQL against DuckDB on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from paperloom.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return float(v) if isinstance(v, Decimal) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def test_every_oracle_has_a_query():
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_gives_the_same_rows_twice(spark, sf, name):
    """Their values are held against plain Python in test_whole_jobs; here over all tables, however they are split."""
    first, again = QUERIES[name](spark, sf), QUERIES[name](spark, sf).repartition(3)
    rows = rows_of(first.columns, first.collect())
    assert rows and rows == rows_of(again.columns, again.collect())
