"""Every query of the core with SQL gives what its SQL gives."""

from __future__ import annotations

import oracle
import pytest
from conftest import FOLDER

from tessera.plans import curation, generation, nested, scalars, spatial, stores, streams

QUERIES = spatial.QUERIES | curation.QUERIES | nested.QUERIES | generation.QUERIES | scalars.QUERIES | stores.QUERIES | streams.QUERIES
SQL = spatial.SQL | curation.SQL | nested.SQL | scalars.SQL | stores.SQL | streams.SQL


@pytest.fixture(scope="module")
def connection():
    return oracle.views(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, connection, name):
    assert oracle.differences(QUERIES[name](spark, FOLDER).toPandas(), connection.sql(SQL[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
