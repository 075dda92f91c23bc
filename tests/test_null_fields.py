"""Queries against their SQL where events lack fields, which the given tables never do."""

import duckdb
import pytest

from tidemark.plans.catalog import ORACLES, QUERIES

from .conftest import DATA


@pytest.fixture(scope="module")
def lacking(tmp_path_factory):
    """Events of the smallest table, some of them without id, time, user, type or value."""
    to = tmp_path_factory.mktemp("lacking")
    con = duckdb.connect()
    every = {"event_id": 7, "ts": 11, "user_id": 13, "event_type": 17, "value": 19}
    kept = ", ".join(f"CASE WHEN event_id % {n} <> 3 THEN {c} END AS {c}" for c, n in every.items())
    con.execute(f"COPY (SELECT * REPLACE ({kept}) FROM '{DATA}/events.parquet') TO '{to}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{to}/events.parquet'")
    return str(to), con


@pytest.mark.parametrize("name", ["replica_missing", "replica_repair"])
def test_query_on_null_fields(spark, lacking, name):
    path, con = lacking
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, path)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
