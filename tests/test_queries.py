"""Every registered activity query against its oracle, at the smallest scale."""

import math

import duckdb
import pytest

from tallyloom.plans import oracles, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    wanted = con.sql(oracles.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert sorted(wanted.columns) == sorted(got.columns)
    assert rows(wanted.columns, wanted.fetchall()) == rows(got.columns, got.collect())


def test_every_oracle_has_a_query():
    assert set(oracles.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) - set(oracles.oracle_sql()) == {"q32d_crawl_rounds", "q42_topological_waves"}
