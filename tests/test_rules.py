"""The rules of the point model on small literal tables."""

from datetime import datetime

import numpy as np
import pytest

from tidemark.functions import text
from tidemark.functions.murmur import murmur3
from tidemark.operators import cluster, replicas
from tidemark.operators import points as P
from tidemark.operators import rollup as R
from tidemark.plans.request import Request, answer, check_range, samples
from tidemark.sources.points import stored
from tidemark.sources.text import parse_log, read_log
from tidemark.streaming import live

COLUMNS = "seq long, device_id string, metric_name string, timestamp long, value double"


@pytest.fixture
def table(spark, tmp_path):
    def made(rows):
        path = str(tmp_path / "points")
        spark.createDataFrame(rows, COLUMNS).write.mode("overwrite").parquet(path)
        return stored(spark, path)

    return made


def test_first_arrival_wins(spark):
    df = spark.createDataFrame([(2, "d", "m", 5, 20.0), (1, "d", "m", 5, 10.0), (3, "d", "m", 6, 30.0)], COLUMNS)
    assert sorted((r.timestamp, r.value) for r in P.first_wins(df).collect()) == [(5, 10.0), (6, 30.0)]


def test_range_is_inclusive_and_open(table):
    t = table([(i, "d", "m", ts, float(ts)) for i, ts in enumerate([9, 10, 15, 20, 21, -5])])
    at = lambda a, b: [r.timestamp for r in samples(t, Request("d", "m", "avg", a, b)).collect()]
    assert at(10, 20) == [10, 15, 20]
    assert at(10, 0) == [10, 15, 20, 21]
    assert at(0, 0) == [9, 10, 15, 20, 21]
    assert at(-10, 0) == [-5, 9, 10, 15, 20, 21]


def test_pushed_filters(spark):
    from tidemark.sources.points import events

    from .conftest import DATA

    plan = samples(events(spark, DATA), Request("sensor_8", "click", "avg", 1_704_500_000, 1_705_400_000))._jdf.queryExecution().toString()
    pushed = plan[plan.rindex("PushedFilters") :].split("\n")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "EqualTo(event_type,click)" in pushed


def test_empty_is_zero_and_bad_operation_fails(table):
    t = table([(1, "d", "m", 5, 1.0)])
    assert answer(t, Request("x", "m", "min")).collect()[0][3:] == (0.0, 0)
    for bad in ("median", "AVG", "count"):
        with pytest.raises(ValueError):
            answer(t, Request("d", "m", bad))
    with pytest.raises(ValueError):
        answer(t, Request("", "m"))


def test_colons_do_not_mix_series(spark):
    df = spark.createDataFrame([(1, "a:b", "c", 1, 1.0), (2, "a", "b:c", 1, 2.0)], COLUMNS)
    assert P.stats(df, "device_id", "metric_name").count() == 2


def test_validation(spark):
    df = spark.createDataFrame([(1, "", "m", 1, 1.0), (2, "d", None, 1, 1.0), (3, "d", "m", 0, 1.0), (4, "d", "m", None, None), (5, "d", "m", 1, float("nan"))], COLUMNS)
    assert [(r.seq, r.timestamp, r.value) for r in P.valid(df, 99).orderBy("seq").collect()] == [(3, 99, 1.0), (4, 99, 0.0)]


def test_late_points_sort(table):
    times = np.random.default_rng(1).permutation(2_500)
    t = table([(i, "d", "m", int(ts) + 1, 1.0) for i, ts in enumerate(times)])
    assert [r.timestamp for r in samples(t, Request("d", "m")).collect()] == list(range(1, 2_501))


def test_deletion_lasts_until_cleared(spark):
    df = spark.createDataFrame([(i, "d", "m", i, 1.0) for i in range(6)] + [(2, "e", "m", 1, 1.0)], COLUMNS)
    marks = spark.createDataFrame([("d", "m", 2, 4)], "device_id string, metric_name string, deleted_seq long, cleared_seq long")
    assert sorted((r.device_id, r.seq) for r in P.written_while_alive(df, marks).collect()) == [("d", 4), ("d", 5), ("e", 2)]


def test_replicas_tie_goes_to_smaller_node(spark):
    df = spark.createDataFrame([("d", "m", n, float(c), c, 0.0, 1.0) for n, c in (("b", 3), ("a", 3), ("c", 2))], "device_id string, metric_name string, node string, sum double, count long, min double, max double")
    best = replicas.best_count(df, 2).collect()
    assert (best[0].node, best[0].answers) == ("a", 3)
    assert replicas.best_count(df, 4).count() == 0


def test_torn_log(spark, tmp_path):
    good = '{"device_id":"d","metric_name":"m","timestamp":5,"value":1.5,"role":"primary"}'
    (tmp_path / "log.json").write_text(f"{good}\nnot json\n{good[:-9]}\n")
    assert [tuple(r) for r in read_log(spark, str(tmp_path / "log.json")).collect()] == [("d", "m", 5, 1.5, "primary")]
    lines = spark.createDataFrame([(good,), (good[:-9],), (None,), ("{}",)], ["line"])
    assert parse_log(lines).count() == 1


@pytest.mark.parametrize(("dod", "bits"), [(0, 1), (-64, 9), (63, 9), (-65, 12), (64, 12), (-256, 12), (255, 12), (-257, 16), (256, 16), (-2048, 16), (2047, 16), (2048, 68)])
def test_bits_of_each_class(spark, dod, bits):
    # the third time lies in another day than the first two
    df = spark.createDataFrame([(i, "d", "m", 86_390 + ts, 1.0) for i, ts in enumerate((0, 9, 18 + dod)) if dod >= 0] or [(i, "d", "m", 90_000 + ts, 1.0) for i, ts in enumerate((0, 5_000, 10_000 + dod))], COLUMNS)
    assert [r.bits for r in P.coded_bits(df).collect()] == [128 + bits]


def test_numbered_series(spark):
    times = sorted(np.random.default_rng(3).choice(10_000_000, 300, replace=False).tolist())
    df = spark.createDataFrame([(i, "d", "m", t, 1.0) for i, t in enumerate(times)] + [(0, "e", "m", 7, 1.0)], COLUMNS)
    got = {(r.device_id, r.timestamp): (r.place, r.before) for r in P.numbered(df).collect()}
    assert got == {("e", 7): (0, [])} | {("d", t): (i, times[max(i - 2, 0) : i]) for i, t in enumerate(times)}


def test_murmur():
    assert murmur3([b"hello", b""]).tolist() == [0x248BFA47, 0]


def test_ring_lookup_equals_a_walk(spark):
    from pyspark.sql import functions as F

    nodes = ["a", "b", "c", "d"]
    places = {}
    for node in nodes:
        places |= dict.fromkeys(murmur3([f"{node}#{i}".encode() for i in range(replicas.VIRTUAL_NODES)]).tolist(), node)
    ring = sorted(places.items())

    def walk(key, n):
        h, found = int(murmur3([key.encode()])[0]), []
        at = next((i for i, (p, _) in enumerate(ring) if p >= h), 0)
        for i in range(len(ring)):
            node = ring[(at + i) % len(ring)][1]
            if node not in found:
                found.append(node)
        return found[:n]

    keys = spark.range(3_000).select(F.concat(F.lit("k:"), "id").alias("series_key"))
    for n in (1, 3, 9):
        got = replicas.placement(keys, nodes, n).collect()
        assert len(got) == 3_000 and all(r.owners == walk(r.series_key, n) for r in got)
    edges = spark.createDataFrame([(p, x) for p, _ in ring[:3] + ring[-3:] for x in (p - 1, p, p + 1)], "place long, h long")
    table = replicas.stretches(spark, nodes, 1)
    near = edges.crossJoin(table).where("h > after AND h <= upto").select("h", "after", "upto").distinct()
    assert near.count() == edges.select("h").distinct().count()
    assert replicas.stretches(spark, [], 2).count() == 0


def test_names(spark):
    row = spark.createDataFrame([("dev>?:m",)], ["k"])
    from pyspark.sql import functions as F

    name = text.segment_name(F.col("k"), F.lit(7))
    key, seq = text.parse_segment_name(name)
    got = row.select(name.alias("n"), key.alias("k"), seq.alias("s")).collect()[0]
    assert got.n.endswith("-00000000000000000007.parq") and (got.k, got.s) == ("dev>?:m", 7)


@pytest.mark.parametrize(("given_", "want", "wrong"), [
    ("02/31/2024 12:00 am", datetime(2024, 3, 2).timestamp, False), ("", None, False), ("0", None, False), ("13/01/2024 01:00 AM", None, True),
    ("01/02/2024 12:30 PM", datetime(2024, 1, 2, 12, 30).timestamp, False), ("01/02/2024 13:30 PM", None, True), ("x/02/2024 01:30 PM", None, True), ("01/02/2024", None, True),
])
def test_parse_time(spark, given_, want, wrong):
    from datetime import timezone

    from pyspark.sql import functions as F

    s, e = text.parse_time(F.col("t"))
    got = spark.createDataFrame([(given_,)], ["t"]).select(s.alias("s"), e.alias("e")).collect()[0]
    moment = int(want.__self__.replace(tzinfo=timezone.utc).timestamp()) if want else 0
    assert (got.s, got.e is not None) == (moment, wrong)


def test_parse_time_takes_a_text_apart_once(spark):
    from pyspark.sql import functions as F

    given_ = [None, " ", "0", "02/31/2024  12:00 am", " 1/2/2024 1:5 pm x", "1/2 01:00 AM", "1/x/2024 01:00 AM", "1/32/2024 01:00 AM", "1/1/1899 01:00 AM", "1/1/2024 1 AM", "1/1/2024 1:x AM", "1/1/2024 1:60 AM", "1/1/2024 0:00 AM", "1/1/2024 1:00 XM", "1/1/2024"]
    want = [None, None, None, None, None, "date must be month/day/year", "date must be whole numbers", "day must be 1 to 31", "year must be 1900 to 2100", "clock must be hour:minute", "clock must be whole numbers", "minute must be 0 to 59", "hour must be 1 to 12", "half must be AM or PM", "text must be a date, a clock time and a half of the day, apart by blanks"]
    s, e = text.parse_time(F.col("t"))
    made = spark.createDataFrame(list(enumerate(given_)), "i int, t string").select("i", s.alias("s"), e.alias("e"))
    got = sorted(made.collect())
    assert [r.e for r in got] == want
    assert [r.s for r in got] == [0, 0, 0, 1_709_337_600, 1_704_200_700, *[0] * 10]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2


def test_form_ranges():
    check_range(0, 0, 10)
    check_range(0, 5, 10)
    for bad in ((5, 0), (5, 5), (6, 5), (1, 11)):
        with pytest.raises(ValueError):
            check_range(*bad, 10)


def test_rollup_with_edges_equals_direct(table):
    t = table([(i, "d", "m", ts, float(ts % 7)) for i, ts in enumerate(range(0, 400, 3))])
    buckets = R.rollup(t.points(), 50)
    for a, b in ((0, 399), (10, 30), (49, 150), (50, 149), (51, 148), (7, 7)):
        direct = P.stats(t.range(a, b).points(), "device_id", "metric_name").collect()
        assert [tuple(r) for r in R.stats_by_rollup(t, buckets, a, b, 50).collect()] == [tuple(r) for r in direct]


def test_empty_cluster(spark):
    import hashlib

    from tidemark.schema import NODE

    assert cluster.merkle_root(spark.createDataFrame([], NODE)).collect()[0].root == hashlib.sha256(b"empty").hexdigest()


@pytest.mark.parametrize("n", [25, 4097, 20_001])
def test_merkle_root_has_every_node(spark, n):
    import hashlib

    from pyspark.sql import functions as F

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    nodes = spark.range(n).select(F.format_string("n%06d", "id").alias("id"), F.lit("a").alias("address"), F.lit("active").alias("status"), F.lit(1).alias("http_port"))
    level = [sha(f"n{i:06}|a|active|1") for i in range(n)]
    while len(level) > 1:
        level = [sha("".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert [r.root for r in cluster.merkle_root(nodes).collect()] == level


def test_replay_twice_is_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "d", "m", i + 1, 1.0) for i in range(20)], COLUMNS)
    src = str(tmp_path / "in")
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(src)
    assert live.appended(live.once(live.incoming(spark, src, 1))).count() == 20


def test_stored_times_are_delta_coded(spark, tmp_path):
    import pyarrow.parquet as pq

    from tidemark.operators import table as stored_table

    path = tmp_path / "t"
    stored_table.append(spark.createDataFrame([(i, "d", "m", 10 * i, 1.0) for i in range(200)], COLUMNS), str(path))
    found = [pq.ParquetFile(f).metadata for f in path.glob("*.parquet")]
    columns = [m.row_group(0).column(i) for m in found if m.num_row_groups for i in range(5)]
    assert columns and all("DELTA_BINARY_PACKED" in c.encodings for c in columns if c.path_in_schema in ("timestamp", "seq"))


def test_first_wins_is_a_hash_aggregate(spark):
    from tidemark.sources.points import events, shipments

    from .conftest import DATA

    for t in (events(spark, DATA), shipments(spark, DATA)):
        plan = P.first_wins(t.points())._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "Sort" not in plan.replace("ObjectHashAggregate", "")


def test_statistics_do_not_sort(spark):
    from tidemark.plans.request import statistics
    from tidemark.sources.points import events

    from .conftest import DATA

    plan = statistics(events(spark, DATA), Request("sensor_8", "click"))._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan


def test_null_order_comes_last_and_rows_are_not_mixed(spark):
    df = spark.createDataFrame([(None, "d", "m", 1, 1.0), (5, "d", "m", 1, 2.0), (None, "d", "m", 2, 3.0)], COLUMNS)
    assert sorted((r.timestamp, r.seq, r.value) for r in P.first_wins(df).collect()) == [(1, 5, 2.0), (2, None, 3.0)]
    from pyspark.sql import functions as F

    wide = spark.createDataFrame([(1, "d", "m", 1, 1.0), (1, "d", "m", 1, 2.0)], COLUMNS).withColumn("copy", F.col("value"))
    assert [r.copy == r.value for r in P.first_wins(wide).collect()] == [True]


def test_huge_bounds(spark):
    from tidemark.sources.points import events

    from .conftest import DATA

    t = events(spark, DATA)
    assert t.range(-(10**15), 10**13).points().count() == t.points().count()


def test_latest_goes_on_after_a_restart(spark, tmp_path):
    df = spark.createDataFrame([(i, "d", "m", i + 1, 1.0) for i in range(30)], COLUMNS)
    src, to = str(tmp_path / "in"), str(tmp_path / "to")
    df.where("seq >= 10").coalesce(1).write.mode("append").parquet(src)
    assert live.latest(live.incoming(spark, src), 15, to).count() == 15
    df.where("seq < 10").coalesce(1).write.mode("append").parquet(src)
    assert sorted(r.seq for r in live.latest(live.incoming(spark, src), 25, to).collect()) == list(range(0, 10)) + list(range(15, 30))
    assert sorted(r.seq for r in live.latest(live.incoming(spark, src), 25, to).collect()) == list(range(0, 10)) + list(range(15, 30))


def test_tombstones(spark, tmp_path):
    from tidemark.operators.tombstones import Tombstones

    marks = Tombstones(spark, str(tmp_path / "marks"))
    assert marks.current().count() == 0 and not marks.has("d", "m")
    one = spark.createDataFrame([("d", "m"), ("d", "m")], "device_id string, metric_name string")
    marks.write(one, 1)
    assert marks.has("d", "m") and marks.current().count() == 1
    marks.remove(one, 1)
    assert not marks.has("d", "m")
    marks.write(one, 2)
    assert [r.deleted_at for r in marks.current().collect()] == [2]


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tidemark import session

    cluster_ = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_dir(cluster_)
