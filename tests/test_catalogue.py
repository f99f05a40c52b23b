"""Every query of the catalogue with SQL gives the rows that DuckDB gives."""

import decimal
from pathlib import Path

import duckdb
import pytest

from loomgraph import queries as catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{p if p.is_file() else str(p) + '/*'}')")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = rows(df.collect(), df.columns)
    c = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in c.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(c.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs_without_sql(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
