"""Every registered query against its SQL in DuckDB, on whole tables."""

import duckdb
import pytest

from lexloom.plans import catalogue, workflows  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    out = catalogue.QUERIES[name](spark, sf_dir)
    got = rows(out.columns, [tuple(r) for r in out.collect()])
    assert got[1], "no rows"
    if name in catalogue.SQL:
        made = duck.execute(catalogue.SQL[name])
        want = rows([d[0] for d in made.description], made.fetchall())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        for a, b in zip(got[1], want[1]):
            assert a == b
