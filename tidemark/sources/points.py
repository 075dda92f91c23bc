"""Point tables: raw tables seen as points, with range and series predicates kept on the stored columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1)
#: Seconds that a timestamp can hold.
LEAST, MOST = ((x - EPOCH) // timedelta(seconds=1) for x in (datetime.min, datetime.max))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def ntz(seconds: int) -> Column:
    """A zone-less timestamp literal, so that comparing a stored column with it reaches the Parquet scan.

    Bounds beyond the years 1 to 9999 count as the first and last second of those.
    """
    within = min(max(seconds, LEAST), MOST)
    return F.lit((EPOCH + timedelta(seconds=within)).isoformat(sep=" ")).cast("timestamp_ntz")


@dataclass(frozen=True)
class PointTable:
    """A stored table and how its rows are points.

    ``raw_range(start, end)`` and ``raw_series(device, metric)`` give predicates on stored columns: filters on
    derived columns would not be pushed into the scan.
    """

    raw: DataFrame
    columns: dict[str, Column]
    raw_range: Callable[[int, int | None], Column]
    raw_series: Callable[[str, str], Column]

    def points(self) -> DataFrame:
        return self.raw.select(*(c.alias(n) for n, c in self.columns.items()))

    def range(self, start: int, end: int) -> PointTable:
        """Both ends inclusive; ``end`` 0 has no upper bound, ``start`` 0 leaves negative times out."""
        return PointTable(self.raw.where(self.raw_range(start, end or None)), self.columns, self.raw_range, self.raw_series)

    def series(self, device: str, metric: str) -> PointTable:
        return PointTable(self.raw.where(self.raw_series(device, metric)), self.columns, self.raw_range, self.raw_series)


def _ntz_range(name: str) -> Callable[[int, int | None], Column]:
    def of(start: int, end: int | None) -> Column:
        least = F.col(name) >= ntz(start)
        return least if end is None else least & (F.col(name) < ntz(end + 1))

    return of


def _numbered(prefix: str, column: str, metric: str) -> Callable[[str, str], Column]:
    def of(device: str, name: str) -> Column:
        number = re.fullmatch(rf"{prefix}(-?\d+)", device)
        return F.col(column).eqNullSafe(int(number[1])) & (F.col(metric) == name) if number else F.lit(False)

    return of


def events(spark: SparkSession, sf_dir: str) -> PointTable:
    """Sensors by user, metrics by event type, in order of event_id."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    columns = {"seq": F.col("event_id"), "device_id": F.concat(F.lit("sensor_"), F.col("user_id")), "metric_name": F.col("event_type"), "timestamp": epoch_seconds(F.col("ts")), "value": F.col("value")}
    return PointTable(raw, columns, _ntz_range("ts"), _numbered("sensor_", "user_id", "event_type"))


def shipments(spark: SparkSession, sf_dir: str) -> PointTable:
    """Suppliers as devices, return flags as metrics, extended prices at ship dates: many repeated times.

    The order of arrival within a series is by order, line, part and price: one number made of the four, 13, 11 and
    9 digits wide, so that aggregates keep it in a buffer of fixed width.
    """
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("decimal(14,0)") * F.lit(Decimal(10**20))
    part = F.col("l_partkey").cast("decimal(11,0)") * F.lit(Decimal(10**9))
    seq = (line + part + F.round(F.col("l_extendedprice") * 100).cast("decimal(9,0)")).cast("decimal(38,0)")
    columns = {"seq": seq, "device_id": F.concat(F.lit("supp_"), F.col("l_suppkey")), "metric_name": F.col("l_returnflag"), "timestamp": epoch_seconds(F.col("l_shipdate")), "value": F.col("l_extendedprice")}
    return PointTable(raw, columns, _ntz_range("l_shipdate"), _numbered("supp_", "l_suppkey", "l_returnflag"))


def stored(spark: SparkSession, path: str) -> PointTable:
    """A table of this engine: the columns are the points'."""
    raw = spark.read.parquet(path)
    names = ("seq", "device_id", "metric_name", "timestamp", "value")

    def between(start: int, end: int | None) -> Column:
        return F.col("timestamp") >= start if end is None else F.col("timestamp").between(start, end)

    return PointTable(raw, {n: F.col(n) for n in names}, between, lambda d, m: (F.col("device_id") == d) & (F.col("metric_name") == m))
