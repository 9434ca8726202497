"""Each registered query against its DuckDB SQL, over whole tables."""

import os

import duckdb
import pytest

from trackloom.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return db


def told(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(told(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(told(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall())
    assert ours == theirs
    assert ours


def test_every_query_but_the_sequential_one_has_sql():
    assert set(catalog.queries()) - set(SQL) == {"identity_resolve_stateful", "stream_identities"}


def test_resolver_covers_every_observation(spark, sf_dir):
    from trackloom.plans import fixtures

    found = catalog.identity_resolve_stateful(spark, sf_dir)
    assert found.count() == fixtures.tracks(spark, sf_dir).count()
    assert found.where("global_id is not null").count() > 0
