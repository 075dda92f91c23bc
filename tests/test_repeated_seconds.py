"""Queries against their SQL where series have several events in one second, which the smallest tables lack."""

from pathlib import Path

import duckdb
import pytest

from tidemark.operators import points as P
from tidemark.plans.catalog import ORACLES, QUERIES
from tidemark.streaming import live

from .conftest import DATA
from .test_catalog import rows


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Events of the smallest table, every third of them followed by one of its series and second with another value."""
    to = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    both = f"SELECT *, 0 AS copy FROM '{DATA}/events.parquet' UNION ALL SELECT * REPLACE (value * 3 + 100 AS value), 1 AS copy FROM '{DATA}/events.parquet' WHERE event_id % 3 = 0"
    con.execute(f"COPY (SELECT * EXCLUDE copy REPLACE (row_number() OVER (ORDER BY ts, event_id, copy) - 1 AS event_id) FROM ({both}) ORDER BY event_id) TO '{to}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{Path(to)}/events.parquet'")
    return str(to), con


@pytest.mark.parametrize("name", ["log_replay_union", "replica_merge", "replica_missing", "replica_repair", "stream_once"])
def test_query_on_repeated_seconds(spark, repeated, name):
    path, con = repeated
    got, want = QUERIES[name](spark, path).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_values_of_one_second_are_coded_as_they_arrived(spark):
    """The SQL of value_sizes leaves the order within a second open; here it is that of arrival, however rows lie."""
    df = spark.createDataFrame([(2, "d", "m", 20, 2.0), (1, "d", "m", 20, 1.0), (0, "d", "m", 10, 1.0)], "seq long, device_id string, metric_name string, timestamp long, value double").coalesce(1)
    assert [r.bits for r in P.value_bits(df).collect()] == [64 + 1 + 66]


@pytest.mark.parametrize("name", ["stream_throughput", "stream_running_stats"])
def test_batches_do_not_become_more_with_files(spark, tmp_path, monkeypatch, name):
    seen = []
    plain = live.incoming

    def noted(spark, path, files_per_trigger=4, role=False):
        seen.append((len(spark.read.parquet(path).inputFiles()), files_per_trigger))
        return plain(spark, path, files_per_trigger, role)

    monkeypatch.setattr(live, "incoming", noted)
    spark.read.parquet(f"{DATA}/events.parquet").repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows(got) == rows(con.execute(ORACLES[name]).fetchdf())
    assert all(n > 4 and -(-n // k) <= 4 for n, k in seen) and seen
