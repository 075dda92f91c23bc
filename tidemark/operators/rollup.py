"""Pre-aggregated buckets, and wide ranges answered from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SERIES
from ..sources.points import PointTable


def rollup(points: DataFrame, width: int = 86_400) -> DataFrame:
    """Partial statistics of each series and bucket of ``width`` seconds; ``bucket`` is its first second."""
    bucket = F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(width))
    return points.groupBy(*SERIES, bucket.alias("bucket")).agg(F.sum("value").alias("sum"), F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"))


def merge(partials: DataFrame, *keys: str) -> DataFrame:
    return partials.groupBy(*keys).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))


def stats_by_rollup(table: PointTable, buckets: DataFrame, start: int, end: int, width: int = 86_400, *keys: str) -> DataFrame:
    """Statistics over [start, end]: whole buckets from ``buckets`` and only the edges from the stored points.

    The points must be free of repeated times, as the buckets were. Edge ranges are pushed to the scan.
    """
    low, high = -(-start // width) * width, (end + 1) // width * width  # whole buckets cover [low, high)
    names = [*SERIES, "sum", "count", "min", "max"]
    one = [F.col("value").alias("sum"), F.lit(1).cast("long").alias("count"), F.col("value").alias("min"), F.col("value").alias("max")]
    if low >= high:
        parts = table.range(start, end).points().select(*SERIES, *one)
    else:
        parts = buckets.where((F.col("bucket") >= low) & (F.col("bucket") < high)).select(*names)
        for a, b in ((start, low - 1), (high, end)):
            if a <= b:
                parts = parts.union(table.range(a, b).points().select(*SERIES, *one))
    return merge(parts, *(keys or SERIES))
