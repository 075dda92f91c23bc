"""Queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.murmur import murmur3_of
from ..operators import cluster, display, replicas, table, tombstones
from ..operators import points as P
from ..operators import rollup as R
from ..schema import LOG_ENTRY, SERIES
from ..session import fresh_dir
from ..sources import segments, text
from ..sources.points import events, shipments
from ..streaming import live
from .request import Request, answer, relative, samples, statistics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: One series, and a range of ten days of January 2024.
DEVICE, METRIC, START, END = "sensor_8", "click", 1_704_500_000, 1_705_400_000
#: A time after all events, for ages and presets.
NOW = 1_706_700_000
NODES = [f"node{i}" for i in range(1, 6)]

E = "(SELECT event_id AS seq, 'sensor_' || user_id AS device_id, event_type AS metric_name, epoch_us(ts) // 1000000 AS timestamp, value FROM events)"
L = "(SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, 'supp_' || l_suppkey AS device_id, l_returnflag AS metric_name, epoch_us(l_shipdate) // 1000000 AS timestamp, l_extendedprice AS value FROM lineitem)"
L1 = f"(SELECT device_id, metric_name, timestamp, value FROM {L} QUALIFY row_number() OVER (PARTITION BY device_id, metric_name, timestamp ORDER BY seq) = 1)"
STATS = "round(sum(value), 4) AS sum, count(*) AS count, round(min(value), 4) AS min, round(max(value), 4) AS max"
DIGEST = "count(*) AS count, CAST(sum(CAST(CAST('0x' || substr(md5(timestamp || '|' || printf('%.6f', value)), 1, 12) AS BIGINT) AS DECIMAL(38,0))) AS VARCHAR) AS checksum"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def E_(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).points()


def L_(spark: SparkSession, sf: str) -> DataFrame:
    return shipments(spark, sf).points()


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return series_stats(spark, sf)


IN_RANGE = f"{E} WHERE device_id = '{DEVICE}' AND metric_name = '{METRIC}' AND timestamp BETWEEN {START} AND {END}"


@query(f"SELECT coalesce(round(sum(value), 4), 0) AS sum, count(*) AS count, coalesce(round(min(value), 4), 0) AS min, coalesce(round(max(value), 4), 0) AS max FROM {IN_RANGE}")
def series_stats(spark, sf):
    return rounded(statistics(events(spark, sf), Request(DEVICE, METRIC, "avg", START, END)))


def _operation(name: str) -> None:
    def f(spark, sf):
        return rounded(answer(events(spark, sf), Request(DEVICE, METRIC, name, START, END)))

    f.__name__ = f"op_{name}"
    query(f"SELECT '{DEVICE}' AS device_id, '{METRIC}' AS metric_name, '{name}' AS operation, coalesce(round({name}(value), 4), 0) AS result, count(*) AS count FROM {IN_RANGE}")(f)


for _name in ("avg", "sum", "min", "max"):
    _operation(_name)


@query(f"SELECT count(*) AS count FROM {IN_RANGE}")
def series_count(spark, sf):
    return events(spark, sf).series(DEVICE, METRIC).range(START, END).points().agg(F.count("*").alias("count"))


@query(f"SELECT '{DEVICE}' AS device_id, '{METRIC}' AS metric_name, 'sum' AS operation, coalesce(round(sum(value), 4), 0) AS result, count(*) AS count FROM {E} WHERE device_id = '{DEVICE}' AND metric_name = '{METRIC}' AND timestamp >= {START}")
def open_end_range(spark, sf):
    return rounded(answer(events(spark, sf), Request(DEVICE, METRIC, "sum", START, 0)))


@query("SELECT 'nobody' AS device_id, 'click' AS metric_name, 'max' AS operation, 0.0::DOUBLE AS result, 0::BIGINT AS count")
def empty_series(spark, sf):
    return answer(events(spark, sf), Request("nobody", "click", "max"))


@query(f"SELECT count(*) FILTER (WHERE timestamp - 1705000000 >= 0) AS from_zero, count(*) FILTER (WHERE timestamp - 1705000000 >= -500000) AS from_negative FROM {E}")
def negative_start(spark, sf):
    shifted = E_(spark, sf).withColumn("timestamp", F.col("timestamp") - 1_705_000_000)
    count = lambda start: F.count_if(F.col("timestamp") >= start)
    return shifted.agg(count(0).alias("from_zero"), count(-500_000).alias("from_negative"))


@query(f"SELECT device_id, metric_name, {STATS} FROM {E} GROUP BY ALL")
def all_series_stats(spark, sf):
    return rounded(P.stats(E_(spark, sf), *SERIES))


@query(f"SELECT device_id, metric_name, {STATS} FROM {L1} GROUP BY ALL")
def dedup_series_stats(spark, sf):
    return rounded(P.stats(P.first_wins(L_(spark, sf)), *SERIES))


@query(f"SELECT timestamp, value FROM {IN_RANGE} ORDER BY timestamp")
def samples_sorted(spark, sf):
    return samples(events(spark, sf), Request(DEVICE, METRIC, "avg", START, END))


@query(f"SELECT value FROM {L1} WHERE device_id = 'supp_8' AND metric_name = 'N' ORDER BY timestamp")
def sample_values(spark, sf):
    return samples(shipments(spark, sf), Request("supp_8", "N")).select("value")


@query(f"SELECT device_id, metric_name, timestamp, value FROM {L1}")
def dedup_first_wins(spark, sf):
    return P.first_wins(L_(spark, sf)).drop("seq")


@query(f"SELECT seq, device_id, metric_name, timestamp, value FROM (SELECT seq, CASE WHEN seq % 7 = 0 THEN '' ELSE device_id END AS device_id, metric_name, CASE WHEN seq % 5 = 0 THEN {NOW} ELSE timestamp END AS timestamp, value FROM {E}) WHERE device_id <> ''")
def ingest_validation(spark, sf):
    e = E_(spark, sf)
    posted = e.withColumn("device_id", F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("device_id"))).withColumn("timestamp", F.when(F.col("seq") % 5 == 0, 0).otherwise(F.col("timestamp")))
    return P.valid(posted, NOW)


@query(f"SELECT DISTINCT device_id FROM {E}")
def device_catalog(spark, sf):
    return P.catalog(E_(spark, sf), "device_id")


@query(f"SELECT DISTINCT metric_name FROM {E}")
def metric_catalog(spark, sf):
    return P.catalog(E_(spark, sf), "metric_name")


@query(f"SELECT DISTINCT device_id || ':' || metric_name AS series_key FROM {E}")
def series_keys(spark, sf):
    return P.keys(E_(spark, sf))


@query(f"SELECT DISTINCT device_id || ':' || metric_name || ':x' AS series_key, device_id, metric_name || ':x' AS metric_name FROM {E}")
def key_split(spark, sf):
    keys = P.keys(E_(spark, sf)).select(F.concat("series_key", F.lit(":x")).alias("series_key"))
    device, metric = X.split_key(F.col("series_key"))
    return keys.select("series_key", device.alias("device_id"), metric.alias("metric_name"))


@query(f"SELECT DISTINCT device_id || ':' || metric_name AS series_key FROM {E} WHERE metric_name IN ('click', 'error') UNION SELECT DISTINCT device_id || ':' || metric_name FROM {E} WHERE metric_name IN ('click', 'view')")
def key_union(spark, sf):
    one, two = (P.keys(E_(spark, sf).where(F.col("metric_name").isin(*m))) for m in (("click", "error"), ("click", "view")))
    return one.union(two).distinct()


@query(f"SELECT device_id, metric_name, timestamp, value FROM {L1} WHERE NOT (device_id IN ('supp_1', 'supp_2') AND metric_name = 'A')")
def tombstone_mask(spark, sf):
    gone = spark.createDataFrame([("supp_1", "A"), ("supp_2", "A")], SERIES)
    return P.without_tombstones(P.first_wins(L_(spark, sf)), gone).drop("seq")


@query(f"SELECT seq, device_id, metric_name, timestamp, value FROM {E} WHERE metric_name <> 'click' OR seq >= (SELECT max(event_id) // 2 FROM events)")
def tombstone_write_drop(spark, sf):
    e = E_(spark, sf)
    half = e.agg(F.floor(F.max("seq") / 2)).scalar()
    marks = e.where("metric_name = 'click'").select(*SERIES).distinct()
    return P.written_while_alive(e, marks.withColumns({"deleted_seq": F.lit(0), "cleared_seq": half}))


@query(f"SELECT device_id, metric_name, timestamp, value FROM {E}")
def log_replay_union(spark, sf):
    e = E_(spark, sf)
    return table.recovered(e.where("seq % 2 = 0"), e).drop("seq")


@query(f"SELECT seq, device_id, metric_name, timestamp, value, CASE WHEN seq % 2 = 0 THEN 'primary' ELSE 'replica' END AS role FROM {E} WHERE seq % 10 <> 3")
def log_lines(spark, sf):
    entries = E_(spark, sf).withColumn("role", F.when(F.col("seq") % 2 == 0, "primary").otherwise("replica"))
    lines = entries.select("seq", F.to_json(F.struct(*SERIES, "timestamp", "value", "role")).alias("line"))
    torn = lines.withColumn("line", F.when(F.col("seq") % 10 == 3, F.substring("line", F.lit(1), F.length("line") - 4)).otherwise(F.col("line")))
    return text.parse_log(torn)


@query(f"SELECT seq, 'sensor_' || (seq % 3 + 1) AS device_id, 'temperature' AS metric_name, CASE WHEN seq % 4 = 3 THEN 0.0 ELSE round(value, 2) END AS value FROM {E}")
def serial_lines(spark, sf):
    value = F.format_string("%.2f", F.round("value", 2))
    device = F.concat(F.lit("sensor_"), F.col("seq") % 3 + 1)
    plain = (F.col("seq") % 3 == 0) & (F.col("seq") % 4 == 2)
    line = F.when(F.col("seq") % 4 == 3, F.concat(device, F.lit(",oops"))).when(plain, F.concat(F.lit("reading "), value)).otherwise(F.concat(F.lit(" "), device, F.lit(" , "), value))
    return text.sensor_lines(E_(spark, sf).select("seq", line.alias("line")))


@query("SELECT event_id AS seq, '{\"device_id\":\"sensor_' || user_id || '\",\"metric_name\":\"' || event_type || '\",\"timestamp\":' || (epoch_us(ts) // 1000000) || '}' AS line FROM events")
def wire_json(spark, sf):
    return E_(spark, sf).select("seq", F.to_json(F.struct(*SERIES, "timestamp")).alias("line"))


@query(f"SELECT device_id, metric_name, round(sum(value), 4) AS sum, count(*) AS count, round(min(value), 4) AS min, round(max(value), 4) AS max FROM {E} WHERE timestamp BETWEEN {START} AND {END} GROUP BY ALL")
def rollup_edges(spark, sf):
    t = events(spark, sf)
    return rounded(R.stats_by_rollup(t, R.rollup(t.points()), START, END))


@query(f"SELECT device_id, metric_name, timestamp - timestamp % 86400 AS bucket, {STATS} FROM {E} GROUP BY ALL")
def rollup_table(spark, sf):
    return rounded(R.rollup(E_(spark, sf)))


@query(f"WITH c AS (SELECT metric_name AS device_id, 'all' AS metric_name, timestamp, value, (row_number() OVER (PARTITION BY metric_name ORDER BY timestamp) - 1) // 1000 AS chunk FROM (SELECT metric_name, timestamp, arg_min(value, seq) AS value FROM {E} GROUP BY ALL)) SELECT device_id, metric_name, chunk, min(timestamp) AS start_time, max(timestamp) AS end_time, round(sum(value), 4) AS sum, round(min(value), 4) AS min, round(max(value), 4) AS max, count(*) AS count FROM c GROUP BY ALL")
def chunk_stats(spark, sf):
    by_type = E_(spark, sf).select("seq", F.col("metric_name").alias("device_id"), F.lit("all").alias("metric_name"), "timestamp", "value")
    return rounded(P.chunk_stats(P.first_wins(by_type)))


@query(f"SELECT device_id, metric_name, count(DISTINCT seq // 500) AS files FROM {E} GROUP BY ALL HAVING count(DISTINCT seq // 500) > 10")
def compaction_plan(spark, sf):
    return table.due(E_(spark, sf).withColumn("file", F.floor(F.col("seq") / 500)))


@query(f"SELECT seq, device_id, metric_name, timestamp, value FROM {E} WHERE metric_name <> 'error'")
def compaction_rewrite(spark, sf):
    path = fresh_dir(spark, "table")
    e = E_(spark, sf)
    for part in (0, 1):
        table.append(e.where(F.col("seq") % 2 == part), f"{path}/raw")
    gone = e.where("metric_name = 'error'").select(*SERIES).distinct()
    return table.compact(spark, f"{path}/raw", f"{path}/compact", gone)


@query(f"SELECT device_id, metric_name, count(*) AS count FROM {E} GROUP BY ALL")
def stored_file_counts(spark, sf):
    path = fresh_dir(spark, "table")
    table.append(E_(spark, sf), path)
    return table.files(table.read(spark, path)).groupBy(*SERIES).agg(F.sum("count").alias("count"))


COPIES = f"(SELECT *, 'A' AS node FROM {E} UNION ALL SELECT *, 'B' FROM {E} WHERE seq % 10 <> 0 UNION ALL SELECT *, 'C' FROM {E} WHERE seq % 3 <> 0)"


def copies(spark, sf) -> DataFrame:
    e = E_(spark, sf)
    kept = F.array_compact(F.array(F.lit("A"), F.when(F.col("seq") % 10 != 0, "B"), F.when(F.col("seq") % 3 != 0, "C")))
    return e.select("*", F.explode(kept).alias("node"))


@query(f"WITH s AS (SELECT device_id, metric_name, node, {STATS} FROM {COPIES} GROUP BY ALL) SELECT device_id, metric_name, node, sum, count, min, max, count(*) OVER (PARTITION BY device_id, metric_name) AS answers FROM s QUALIFY row_number() OVER (PARTITION BY device_id, metric_name ORDER BY count DESC, node) = 1")
def replica_best_count(spark, sf):
    return rounded(replicas.best_count(P.stats(copies(spark, sf), *SERIES, "node")))


@query(f"WITH s AS (SELECT device_id, metric_name, node, {STATS} FROM {COPIES} WHERE node = 'A' OR seq % 30 = 1 GROUP BY ALL) SELECT device_id, metric_name, node, sum, count, min, max, count(*) OVER (PARTITION BY device_id, metric_name) AS answers FROM s QUALIFY row_number() OVER (PARTITION BY device_id, metric_name ORDER BY count DESC, node) = 1 AND count(*) OVER (PARTITION BY device_id, metric_name) >= 2")
def replica_quorum(spark, sf):
    some = copies(spark, sf).where("node = 'A' OR seq % 30 = 1")
    return rounded(replicas.best_count(P.stats(some, *SERIES, "node"), quorum=2))


@query(f"SELECT device_id, metric_name, timestamp, arg_min(CASE WHEN node = 'C' THEN value + 1 ELSE value END, node) AS value FROM {COPIES} WHERE node <> 'A' GROUP BY ALL")
def replica_merge(spark, sf):
    two = copies(spark, sf).where("node <> 'A'").withColumn("value", F.when(F.col("node") == "C", F.col("value") + 1).otherwise(F.col("value")))
    return replicas.merge_samples(two.withColumn("priority", F.col("node")))


@query(f"SELECT device_id, metric_name, {DIGEST} FROM {E} GROUP BY ALL")
def series_digest(spark, sf):
    return replicas.digest(E_(spark, sf))


@query(f"WITH a AS (SELECT device_id, metric_name, {DIGEST} FROM {E} WHERE seq % 40 <> 0 GROUP BY ALL), b AS (SELECT device_id, metric_name, {DIGEST} FROM {E} WHERE metric_name <> 'view' GROUP BY ALL) SELECT device_id, metric_name, coalesce(a.count, 0) AS local_count, coalesce(b.count, 0) AS peer_count, coalesce(b.count, 0) > coalesce(a.count, 0) AS pull FROM a FULL JOIN b USING (device_id, metric_name) WHERE a.checksum IS DISTINCT FROM b.checksum")
def replica_diff(spark, sf):
    e = E_(spark, sf)
    return replicas.differing(replicas.digest(e.where("seq % 40 <> 0")), replicas.digest(e.where("metric_name <> 'view'")))


@query(f"SELECT seq, device_id, metric_name, timestamp, value FROM {E} WHERE seq % 10 = 0")
def replica_missing(spark, sf):
    e = E_(spark, sf)
    return replicas.missing(e.where("NOT seq % 10 <=> 0"), e)


@query(f"SELECT seq, device_id, metric_name, timestamp, value FROM {E}")
def replica_repair(spark, sf):
    e = E_(spark, sf)
    return replicas.repair(e.where("NOT seq % 10 <=> 0"), e.where("seq % 3 = 0 OR seq % 10 = 0"))


@query()
def key_hash(spark, sf):
    return P.keys(E_(spark, sf)).select("series_key", murmur3_of(F.col("series_key")).alias("hash"))


@query()
def ring_placement(spark, sf):
    return replicas.placement(P.keys(E_(spark, sf)), NODES, 3)


@query()
def ring_owned(spark, sf):
    placed = ring_placement(spark, sf)
    return placed.where(F.array_contains("owners", NODES[0])).select("series_key")


@query()
def ring_moves(spark, sf):
    return replicas.moved(P.keys(E_(spark, sf)), NODES, NODES[:-1], 2)


@query()
def ring_load(spark, sf):
    return ring_placement(spark, sf).select(F.explode("owners").alias("node")).groupBy("node").agg(F.count("*").alias("series"))


@query(f"SELECT seq, device_id, metric_name, timestamp, value FROM {E} ORDER BY seq DESC LIMIT 100")
def latest_100(spark, sf):
    return display.latest(E_(spark, sf))


@query(f"SELECT timestamp, count(*) AS points FROM {E} GROUP BY ALL")
def throughput_1s(spark, sf):
    return live.throughput(E_(spark, sf))


@query(f"SELECT device_id, metric_name, min(timestamp) AS min_time, max(timestamp) AS max_time, min(value) AS min_value, max(value) AS max_value, CASE WHEN max(timestamp) = min(timestamp) THEN 1 ELSE max(timestamp) - min(timestamp) END AS time_range, round(CASE WHEN max(value) = min(value) THEN 1 ELSE max(value) - min(value) END, 4) AS value_range, round(avg(value), 6) AS average FROM {E} GROUP BY ALL")
def plot_bounds(spark, sf):
    return rounded(display.bounds(E_(spark, sf)).withColumn("value_range", F.round("value_range", 4)), 6)


@query(f"SELECT device_id, metric_name, tick::INT AS tick, round(lo + span * tick / 5, 4) AS tick_value FROM (SELECT device_id, metric_name, min(value) AS lo, CASE WHEN max(value) = min(value) THEN 1 ELSE max(value) - min(value) END AS span FROM {E} GROUP BY ALL), (SELECT unnest(range(0, 6)) AS tick)")
def axis_ticks(spark, sf):
    return rounded(display.ticks(display.bounds(E_(spark, sf))))


@query(f"SELECT seq, round((timestamp - t0) / t1::DOUBLE, 6) AS x, round((value - v0) / v1, 6) AS y FROM {E} JOIN (SELECT device_id, metric_name, min(timestamp) AS t0, CASE WHEN max(timestamp) = min(timestamp) THEN 1 ELSE max(timestamp) - min(timestamp) END AS t1, min(value) AS v0, CASE WHEN max(value) = min(value) THEN 1 ELSE max(value) - min(value) END AS v1 FROM {E} GROUP BY ALL) USING (device_id, metric_name)")
def plot_points(spark, sf):
    return rounded(display.plotted(E_(spark, sf)).select("seq", "x", "y"), 6)


@query("SELECT DISTINCT 'sensor_' || user_id AS device_id, 'Sensor ' || user_id AS device_label, event_type AS metric_name, upper(event_type[1]) || event_type[2:] AS metric_label FROM events")
def labels(spark, sf):
    e = E_(spark, sf).select(*SERIES).distinct()
    return e.select("device_id", X.device_label(F.col("device_id")).alias("device_label"), "metric_name", X.capitalized(F.col("metric_name")).alias("metric_label"))


@query("SELECT op AS operation, CASE lower(op) WHEN 'avg' THEN 'Average' WHEN 'sum' THEN 'Sum' WHEN 'max' THEN 'Maximum' WHEN 'min' THEN 'Minimum' ELSE op END AS label FROM (VALUES ('avg'), ('SUM'), ('max'), ('min'), ('median')) t(op)")
def operation_labels(spark, sf):
    ops = spark.createDataFrame([(x,) for x in ("avg", "SUM", "max", "min", "median")], ["operation"])
    return ops.select("operation", X.operation_label(F.col("operation")).alias("label"))


@query("SELECT event_id AS seq, format('{:,}', event_id * 12345) || ' ns' AS label FROM events")
def duration_labels(spark, sf):
    return E_(spark, sf).select("seq", X.duration_label(F.col("seq") * 12345).alias("label"))


@query("SELECT event_id AS seq, strftime(ts, '%m/%d/%Y %I:%M %p') AS time_label, ltrim(strftime(ts, '%I:%M:%S %p'), '0') AS clock_label, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def format_time(spark, sf):
    t = F.col("timestamp")
    return E_(spark, sf).select("seq", X.time_label(t).alias("time_label"), X.clock_label(t).alias("clock_label"), X.stamp_label(t).alias("stamp"))


@query("SELECT event_id AS seq, epoch_us(date_trunc('minute', ts)) // 1000000 AS seconds, NULL::VARCHAR AS error FROM events")
def parse_time(spark, sf):
    written = E_(spark, sf).select("seq", X.time_label(F.col("timestamp")).alias("t"))
    seconds, error = X.parse_time(F.col("t"))
    return written.select("seq", seconds.alias("seconds"), error.alias("error"))


@query(f"SELECT event_id, value, user_id FROM (SELECT event_id, value, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def lww_state(spark, sf):
    raw = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "ts", "value")
    return cluster.latest(raw, "user_id", ("ts", "event_id")).select("event_id", "value", "user_id")


NODE_SQL = f"(SELECT 'node' || n_nationkey AS id, '10.0.0.' || n_nationkey AS address, (8080 + n_nationkey)::INT AS http_port, {NOW} - n_nationkey AS last_heartbeat, CASE WHEN n_nationkey % 6 = 5 THEN 'down' ELSE 'active' END AS status FROM nation UNION ALL SELECT 'router1', '10.0.1.1', 8000, {NOW}, 'active')"


def nodes(spark, sf) -> DataFrame:
    n = F.col("n_nationkey")
    own = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("node"), n).alias("id"), F.concat(F.lit("10.0.0."), n).alias("address"), (n + 8080).alias("http_port"), (F.lit(NOW) - n).alias("last_heartbeat"), F.when(n % 6 == 5, "down").otherwise("active").alias("status"))
    return own.union(spark.createDataFrame([("router1", "10.0.1.1", 8000, NOW, "active")], own.schema))


@query(f"SELECT id, address, http_port, last_heartbeat, CASE WHEN {NOW} - last_heartbeat > 10 THEN 'down' WHEN {NOW} - last_heartbeat > 4 AND status = 'active' THEN 'suspect' ELSE status END AS status FROM {NODE_SQL}")
def failure_state(spark, sf):
    return cluster.detected(nodes(spark, sf), NOW)


@query(f"SELECT id, address FROM {NODE_SQL} WHERE status = 'active' AND NOT starts_with(id, 'router')")
def active_nodes(spark, sf):
    return cluster.active(nodes(spark, sf)).select("id", "address")


@query(f"SELECT status, count(*) AS nodes FROM {NODE_SQL} GROUP BY ALL")
def node_counts(spark, sf):
    return nodes(spark, sf).groupBy("status").agg(F.count("*").alias("nodes"))


@query(f"SELECT id, CASE WHEN status = 'active' THEN 'add' ELSE 'remove' END AS change FROM {NODE_SQL} LEFT JOIN (SELECT 'node' || n_nationkey AS on_id FROM nation WHERE n_nationkey % 2 = 1) ON id = on_id WHERE (status = 'active' AND on_id IS NULL) OR (status = 'down' AND on_id IS NOT NULL)")
def ring_diff(spark, sf):
    ring = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey % 2 = 1").select(F.concat(F.lit("node"), "n_nationkey").alias("id"))
    return cluster.ring_changes(nodes(spark, sf), ring)


def _merkle_sql() -> str:
    steps = [f"l0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, sha256(id || '|' || address || '|' || status || '|' || http_port) AS h FROM {NODE_SQL})"]
    for k in range(1, 6):
        steps.append(f"l{k} AS (SELECT i // 2 AS i, CASE WHEN count(*) = 2 THEN sha256(max(h) FILTER (WHERE i % 2 = 0) || max(h) FILTER (WHERE i % 2 = 1)) ELSE max(h) END AS h FROM l{k - 1} GROUP BY i // 2)")
    return "WITH " + ", ".join(steps) + " SELECT h AS root FROM l5"


@query(_merkle_sql())
def merkle_root(spark, sf):
    return cluster.merkle_root(nodes(spark, sf))


@query()
def random_peers(spark, sf):
    return cluster.active(nodes(spark, sf)).orderBy(F.rand(7)).limit(3)


@query(f"SELECT count(*) AS points, count(DISTINCT device_id) AS devices FROM {E} WHERE contains(lower(device_id), 'or_1') AND lower(metric_name) = 'click'")
def text_filters(spark, sf):
    found = E_(spark, sf).where(display.contains("device_id", "OR_1") & display.equals("metric_name", "Click") & display.selected("device_id", "all"))
    return found.agg(F.count("*").alias("points"), F.count_distinct("device_id").alias("devices"))


@query(f"SELECT device_id, count(*) AS points, max(timestamp) AS newest FROM {E} GROUP BY ALL")
def device_groups(spark, sf):
    return E_(spark, sf).groupBy("device_id").agg(F.count("*").alias("points"), F.max("timestamp").alias("newest"))


@query(f"SELECT name, count(*) AS points FROM (VALUES ('1h', {NOW - 3600}), ('24h', {NOW - 86400}), ('7d', {NOW - 604800}), ('all', 0)) p(name, lo) JOIN {E} ON timestamp BETWEEN lo AND {NOW} GROUP BY ALL")
def relative_ranges(spark, sf):
    t, out = events(spark, sf), None
    for name in ("1h", "24h", "7d", "all"):
        one = t.range(*relative(name, NOW)).points().groupBy(F.lit(name).alias("name")).agg(F.count("*").alias("points"))
        out = one if out is None else out.union(one)
    return out


@query(f"SELECT DISTINCT ON (device_id, metric_name) device_id, metric_name FROM {E} WHERE NOT (device_id = 'sensor_8' AND metric_name = 'click')")
def pending_tasks(spark, sf):
    waiting = E_(spark, sf).where(~((F.col("device_id") == "sensor_8") & (F.col("metric_name") == "click")))
    return waiting.select(*SERIES).dropDuplicates(SERIES)


@query("SELECT device_id || ':' || metric_name AS series_key, rtrim(replace(replace(to_base64((device_id || ':' || metric_name)::BLOB), '+', '-'), '/', '_'), '=') || '-' || lpad(n::VARCHAR, 20, '0') || '.parq' AS name, n AS sequence FROM (SELECT device_id, metric_name, count(*) AS n FROM " + E + " GROUP BY ALL)")
def segment_names(spark, sf):
    counted = E_(spark, sf).groupBy(*SERIES).agg(F.count("*").alias("n"))
    named = counted.select(X.segment_name(X.series_key(F.col("device_id"), F.col("metric_name")), F.col("n")).alias("name"))
    return segments.listing(named)


@query(f"SELECT device_id, metric_name, timestamp, value FROM {E}")
def segment_roundtrip(spark, sf):
    return segments.round_trip(E_(spark, sf), fresh_dir(spark, "table")).drop("seq")


@query("WITH d AS (SELECT device_id, metric_name, row_number() OVER w AS r, timestamp - 2 * lag(timestamp) OVER w + lag(timestamp, 2) OVER w AS dod FROM " + E + " WINDOW w AS (PARTITION BY device_id, metric_name ORDER BY timestamp)) SELECT device_id, metric_name, CAST(ceil(sum(CASE WHEN r <= 2 THEN 64 WHEN dod = 0 THEN 1 WHEN dod BETWEEN -64 AND 63 THEN 9 WHEN dod BETWEEN -256 AND 255 THEN 12 WHEN dod BETWEEN -2048 AND 2047 THEN 16 ELSE 68 END) / 8.0) AS BIGINT) AS bytes FROM d GROUP BY ALL")
def codec_sizes(spark, sf):
    return P.coded_bits(E_(spark, sf)).select(*SERIES, F.ceil(F.col("bits") / 8).cast("long").alias("bytes"))


@query("WITH d AS (SELECT device_id, metric_name, value, lag(value) OVER (PARTITION BY device_id, metric_name, timestamp // 86400 ORDER BY timestamp) AS before FROM (SELECT device_id, metric_name, timestamp, round(value / 100) AS value FROM " + E + ")) SELECT device_id, metric_name, sum(CASE WHEN before IS NULL THEN 64 WHEN before = value THEN 1 ELSE 66 END)::BIGINT AS bits FROM d GROUP BY ALL")
def value_sizes(spark, sf):
    return P.value_bits(E_(spark, sf).withColumn("value", F.round(F.col("value") / 100)))


@query(f"SELECT device_id || ':' || metric_name AS series_key, count(*) AS count FROM {E} GROUP BY ALL")
def segment_digests(spark, sf):
    path = fresh_dir(spark, "table")
    table.append(E_(spark, sf), path)
    return segments.digests(spark, path).groupBy(X.series_key(F.col("device_id"), F.col("metric_name")).alias("series_key")).agg(F.sum("count").alias("count"))


@query(f"SELECT device_id, metric_name, {DIGEST} FROM {E} GROUP BY ALL")
def segment_checksums(spark, sf):
    """The checksums of a series' files add up to that of its points, however they are divided."""
    path = fresh_dir(spark, "table")
    table.append(E_(spark, sf), path)
    return segments.digests(spark, path).groupBy(*SERIES).agg(F.sum("count").alias("count"), F.sum("checksum").cast("decimal(38,0)").cast("string").alias("checksum"))


@query(f"SELECT seq, device_id, metric_name, timestamp, value FROM {E} WHERE (metric_name <> 'error' AND seq % 4 <> 3) OR (metric_name = 'error' AND seq % 4 = 3)")
def delete_compact_write(spark, sf):
    path = fresh_dir(spark, "deletion")
    e, marks = E_(spark, sf), tombstones.Tombstones(spark, f"{path}/marks")
    gone = e.where("metric_name = 'error'").select(*SERIES).distinct()
    tombstones.append_alive(e.where("seq % 4 = 0"), f"{path}/raw", marks)
    pending = tombstones.delete(gone, marks, 1, e.where("seq % 4 = 1"))
    table.append(pending, f"{path}/raw")
    tombstones.append_alive(e.where("seq % 4 = 2"), f"{path}/raw", marks)  # what is posted of a deleted series is dropped
    tombstones.compact(spark, f"{path}/raw", f"{path}/new", marks, 2)
    tombstones.append_alive(e.where("seq % 4 = 3 AND metric_name = 'error'"), f"{path}/new", marks)
    return table.read(spark, f"{path}/new")


@query(f"SELECT DISTINCT device_id, metric_name, 5::BIGINT AS deleted_at FROM {E} WHERE metric_name = 'view'")
def tombstone_store(spark, sf):
    marks = tombstones.Tombstones(spark, fresh_dir(spark, "marks"))
    series = E_(spark, sf).select(*SERIES).distinct()
    marks.write(series.where("metric_name IN ('error', 'view')"), 3)
    marks.remove(series.where("metric_name = 'error'"), 4)
    marks.write(series.where("metric_name = 'view'"), 5)
    return marks.current()


@query(f"SELECT id, address, http_port, CASE WHEN id = 'node5' THEN {NOW} + 9 WHEN n % 2 = 0 THEN {NOW} + 1 ELSE {NOW} - n END AS last_heartbeat, CASE WHEN id = 'node5' THEN 'active' WHEN n % 2 = 0 THEN 'suspect' WHEN n % 6 = 5 THEN 'down' ELSE 'active' END AS status FROM (SELECT 'node' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN '10.9.0.' ELSE '10.0.0.' END || n_nationkey AS address, (8080 + n_nationkey)::INT AS http_port, n_nationkey AS n FROM nation) UNION ALL SELECT 'router1', '10.0.1.1', 8000, {NOW}, 'active'")
def gossip_merge(spark, sf):
    n = F.col("n_nationkey")
    newer = spark.read.parquet(f"{sf}/nation.parquet").where(n % 2 == 0).select(F.concat(F.lit("node"), n).alias("id"), F.concat(F.lit("10.9.0."), n).alias("address"), F.lit(9).alias("http_port"), F.lit(NOW + 1).cast("long").alias("last_heartbeat"), F.lit("suspect").alias("status"))
    older = nodes(spark, sf).where("id IN ('node1', 'node5')").withColumn("last_heartbeat", F.col("last_heartbeat").cast("long") - 5).withColumn("status", F.lit("down"))
    local = nodes(spark, sf).withColumn("last_heartbeat", F.col("last_heartbeat").cast("long"))
    return cluster.merged(local, newer.unionByName(older), "node5", NOW + 9)


@query("SELECT 3::BIGINT AS peers, 3::BIGINT AS different, 0::BIGINT AS inactive")
def random_peer_count(spark, sf):
    known = cluster.active(nodes(spark, sf)).select("id", F.lit(True).alias("known"))
    drawn = random_peers(spark, sf).select("id").join(known, "id", "left")
    return drawn.agg(F.count("*").alias("peers"), F.count_distinct("id").alias("different"), F.count_if(F.col("known").isNull()).alias("inactive"))


@query("SELECT event_id AS seq, printf('%.4f', value / 3) AS four, printf('%.2f', value / 3) AS two FROM events")
def fixed_decimals(spark, sf):
    return E_(spark, sf).select("seq", X.fixed(F.col("value") / 3, 4).alias("four"), X.fixed(F.col("value") / 3, 2).alias("two"))


@query(f"SELECT DISTINCT device_id, CASE device_id WHEN 'sensor_1' THEN '#4CAF50' WHEN 'sensor_2' THEN '#2196F3' WHEN 'sensor_3' THEN '#FF9800' ELSE '#9E9E9E' END AS colour FROM {E}")
def device_colours(spark, sf):
    return E_(spark, sf).select("device_id").distinct().select("device_id", X.device_colour(F.col("device_id")).alias("colour"))


def _landed(spark, sf, parts: int = 4) -> str:
    path = fresh_dir(spark, "incoming")
    e = E_(spark, sf)
    for part in range(parts):
        e.where(F.col("seq") % parts == part).write.mode("append").parquet(path)
    return path


def _posted(spark, sf, parts: int = 4) -> DataFrame:
    """All points as a stream of about ``parts`` batches, whatever the number of files that a large table lands as.

    Each batch writes the state and, in complete mode, the whole result: a batch a file would make that grow with the
    square of the table.
    """
    path = _landed(spark, sf, parts)
    return live.incoming(spark, path, -(-len(spark.read.parquet(path).inputFiles()) // parts))


@query(ORACLES["all_series_stats"])
def stream_running_stats(spark, sf):
    return rounded(live.complete(live.running_stats(_posted(spark, sf))))


@query(ORACLES["throughput_1s"])
def stream_throughput(spark, sf):
    return live.complete(live.throughput(_posted(spark, sf)))


@query(ORACLES["latest_100"])
def stream_latest_100(spark, sf):
    return live.latest(_posted(spark, sf))


@query(f"SELECT count(*) AS points, count(DISTINCT (device_id, metric_name, timestamp)) AS different FROM {E}")
def stream_once(spark, sf):
    path = _landed(spark, sf, 1)
    E_(spark, sf).write.mode("append").parquet(path)  # all of it again
    got = live.appended(live.once(live.incoming(spark, path, 64), "60 days"))
    return got.agg(F.count("*").alias("points"), F.count_distinct(*SERIES, "timestamp").alias("different"))


@query(f"SELECT seq, device_id, metric_name, timestamp, value FROM {E}")
def stream_ingest(spark, sf):
    to = fresh_dir(spark, "table")
    live.ingest(_posted(spark, sf), f"{to}/data", f"{to}/log").awaitTermination()
    return table.read(spark, f"{to}/data")


@query(f"SELECT device_id, metric_name, timestamp, value, CASE WHEN seq % 2 = 0 THEN 'primary' ELSE 'replica' END AS role FROM {E}")
def stream_feed(spark, sf):
    to = fresh_dir(spark, "table")
    posted = E_(spark, sf).withColumn("role", F.when(F.col("seq") % 2 == 0, "primary").otherwise("replica"))
    for part in (0, 1):
        posted.where(F.floor(F.col("seq") / 2) % 2 == part).write.mode("append").parquet(f"{to}/in")
    live.published(live.incoming(spark, f"{to}/in", 1, role=True), f"{to}/data", f"{to}/feed", f"{to}/log").awaitTermination()
    stored = table.read(spark, f"{to}/data").select(*SERIES, "timestamp")
    return spark.read.schema(LOG_ENTRY).json(f"{to}/feed").select(*LOG_ENTRY.names).join(stored, [*SERIES, "timestamp"], "left_semi").select(*LOG_ENTRY.names)


@query(f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type AS metric_name, count(*) AS points, round(avg(value), 4) AS average FROM events GROUP BY ALL")
def daily_buckets(spark, sf):
    raw = spark.read.parquet(f"{sf}/events.parquet")
    return rounded(raw.groupBy(F.window("ts", "1 day")["start"].alias("day"), F.col("event_type").alias("metric_name")).agg(F.count("*").alias("points"), F.avg("value").alias("average")))
