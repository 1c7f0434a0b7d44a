"""Every query of the library's own operators against DuckDB on the smallest tables."""

import duckdb
import pytest

from glyphmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canon(rows):
    return sorted(repr([round(float(v), 5) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, bool)) else int(v) if v is not None else None for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    wanted = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(r[i] for i in order) for r in wanted.fetchall()]
    assert canon([tuple(r) for r in found.select(*columns).collect()]) == canon(expected)


def test_every_query_has_an_oracle_or_is_listed():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
