"""Requests for one series over one time range, checked and turned into plans; nothing runs until a caller acts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import points as P
from ..sources.points import PointTable

HOURS = {"1h": 1, "24h": 24, "7d": 168}


@dataclass(frozen=True)
class Request:
    """``start_time`` and ``end_time`` are inclusive Unix seconds; an end of 0 has no bound, a start of 0 is 0."""

    device_id: str
    metric_name: str
    operation: str = "avg"
    start_time: int = 0
    end_time: int = 0

    def checked(self) -> Request:
        if not self.device_id or not self.metric_name:
            raise ValueError("a request needs a device and a metric")
        if self.operation not in P.OPERATIONS:
            raise ValueError(f"unknown operation {self.operation!r}")
        return self


def relative(name: str, now: int) -> tuple[int, int]:
    """The range of a preset: the last hours up to ``now``, or all."""
    return (0, now) if name == "all" else (now - 3_600 * HOURS[name], now)


def check_range(start: int, end: int, now: int) -> None:
    """What a form refuses: a start without an end, a start not before the end, and times to come."""
    if start and not end:
        raise ValueError("a start time needs an end time")
    if start and start >= end:
        raise ValueError("the start must be before the end")
    if start > now or end > now:
        raise ValueError("times must not be in the future")


def found(table: PointTable, r: Request, tombstones: DataFrame | None = None) -> DataFrame:
    """(timestamp, value) of the request's points in no order, each time once; aggregates start from these."""
    r = r.checked()
    points = table.series(r.device_id, r.metric_name).range(r.start_time, r.end_time).points()
    if tombstones is not None:
        points = P.without_tombstones(points, tombstones)
    return P.first_wins(points).select("timestamp", "value")


def samples(table: PointTable, r: Request, tombstones: DataFrame | None = None) -> DataFrame:
    """(timestamp, value) in order of time, each time once."""
    return found(table, r, tombstones).orderBy("timestamp")


def answer(table: PointTable, r: Request, tombstones: DataFrame | None = None) -> DataFrame:
    """One row: the request's series and operation, its result, and the count of points; zeros for an empty range."""
    points = found(table, r, tombstones)
    named = [F.lit(x).alias(n) for n, x in (("device_id", r.device_id), ("metric_name", r.metric_name), ("operation", r.operation))]
    return P.operation(points, r.operation).select(*named, "result", "count")


def statistics(table: PointTable, r: Request) -> DataFrame:
    """sum, count, min and max of the request's points."""
    return P.stats(found(table, r).select("value"))
