"""What a monitor shows of points: bounds, ticks, normalized values, latest points, text filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SERIES


def bounds(points: DataFrame, *keys: str) -> DataFrame:
    """Extremes of time and value and their ranges; a range of 0 counts as 1."""
    span = lambda c: F.coalesce(F.nullif(F.max(c) - F.min(c), F.lit(0)), F.lit(1))
    return points.groupBy(*(keys or SERIES)).agg(
        F.min("timestamp").alias("min_time"), F.max("timestamp").alias("max_time"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        span("timestamp").alias("time_range"), span("value").alias("value_range"), F.avg("value").alias("average"),
    )


def ticks(limits: DataFrame, count: int = 6) -> DataFrame:
    """``count`` evenly spaced values from the smallest to the largest of each row of `bounds`."""
    steps = limits.select(*SERIES, "min_value", "value_range", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("tick"))
    return steps.select(*SERIES, "tick", (F.col("min_value") + F.col("value_range") * F.col("tick") / (count - 1)).alias("tick_value"))


def normalized(points: DataFrame) -> DataFrame:
    """Points with x and y from 0 to 1 within their series."""
    placed = points.join(bounds(points).select(*SERIES, "min_time", "time_range", "min_value", "value_range"), SERIES)
    x = (F.col("timestamp") - F.col("min_time")) / F.col("time_range")
    y = (F.col("value") - F.col("min_value")) / F.col("value_range")
    return placed.select(*points.columns, x.alias("x"), y.alias("y"))


def plotted(points: DataFrame) -> DataFrame:
    """`normalized` in the order a line is drawn: by series, then time, then arrival."""
    return normalized(points).orderBy(*SERIES, "timestamp", "seq")


def latest(points: DataFrame, n: int = 100) -> DataFrame:
    return points.orderBy(F.desc("seq")).limit(n)


def contains(column: str, wanted: str) -> Column:
    return F.lower(column).contains(wanted.lower())


def equals(column: str, wanted: str) -> Column:
    return F.lower(column) == wanted.lower()


def selected(column: str, wanted: str) -> Column:
    """``all`` selects everything."""
    return F.lit(True) if wanted == "all" else F.col(column) == wanted
