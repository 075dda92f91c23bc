"""Rules of the point model: validation, first arrival wins, tombstones, and statistics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import series_key
from ..schema import SERIES

#: Operations of a request, matched as written; each with its value where no row is in range.
OPERATIONS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def valid(points: DataFrame, now: int | Column | None = None) -> DataFrame:
    """Points that have a device, a metric and a finite value; a zero or absent time becomes ``now``."""
    at = F.unix_timestamp() if now is None else F.lit(now) if isinstance(now, int) else now
    stamp = F.when(F.coalesce("timestamp", F.lit(0)) == 0, at).otherwise(F.col("timestamp"))
    value = F.coalesce("value", F.lit(0.0))
    named = (F.coalesce(F.length("device_id"), F.lit(0)) > 0) & (F.coalesce(F.length("metric_name"), F.lit(0)) > 0)
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return points.where(named & finite).withColumns({"timestamp": stamp.cast("long"), "value": value})


def first_wins(points: DataFrame, *order: str) -> DataFrame:
    """One point for each series and time: the first by ``order`` (seq by default).

    An aggregate rather than a window: rows of a time are combined before the shuffle. With a numeric ``seq`` and one
    more column, as points have, its buffers are of fixed width and it is a hash aggregate, so nothing is sorted; other
    columns are taken together from one row. A null order comes last; of equal orders any row counts.
    """
    order = order or ("seq",)
    rest = [c for c in points.columns if c not in (*SERIES, "timestamp")]
    keys = [*SERIES, "timestamp"]
    if order == ("seq",) and len(rest) <= 2:
        kind = points.schema["seq"].dataType.simpleString()
        last = F.coalesce("seq", F.lit(Decimal(10**38 - 1) if kind.startswith("decimal") else (1 << 63) - 1))
        own = [(F.min(c) if c == "seq" else F.min_by(c, last)).alias(c) for c in rest]
        return points.groupBy(*keys).agg(*own).select(*points.columns)
    ranked = [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    first = points.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*ranked)).alias("_f"))
    return first.select(*[f"_f.{c}" if c in rest else c for c in points.columns])


def without_tombstones(points: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Points of series that aren't deleted. Spark broadcasts the tombstones where their size allows."""
    return points.join(tombstones.select(*SERIES).distinct(), SERIES, "left_anti").select(*points.columns)


def written_while_alive(points: DataFrame, marks: DataFrame) -> DataFrame:
    """Points that storing would keep: those that didn't arrive from a deletion up to its clearing, nor before one.

    ``marks`` has device_id, metric_name, deleted_seq and cleared_seq (null: not cleared yet); a series may have
    several. What was stored before a deletion goes with it; what arrives before the clearing is dropped.
    """
    m = marks.select(*SERIES, F.coalesce("cleared_seq", F.lit((1 << 63) - 1)).alias("_to"))
    dead = m.groupBy(*SERIES).agg(F.max("_to").alias("_to"))
    kept = points.join(dead, SERIES, "left").where(F.col("_to").isNull() | (F.col("seq") >= F.col("_to")))
    return kept.select(*points.columns)


def stats(points: DataFrame, *keys: str) -> DataFrame:
    """sum, count, min and max; without keys one row, of zeros where there are no points."""
    zero = lambda c: c if keys else F.coalesce(c, F.lit(0.0))
    aggs = [zero(F.sum("value")).alias("sum"), F.count("value").alias("count"), zero(F.min("value")).alias("min"), zero(F.max("value")).alias("max")]
    return points.groupBy(*keys).agg(*aggs)


def operation(points: DataFrame, name: str) -> DataFrame:
    """(result, count) of one operation over all ``points``; zeros where there are none. Names are case-sensitive."""
    if name not in OPERATIONS:
        raise ValueError(f"unknown operation {name!r}; known: {', '.join(sorted(OPERATIONS))}")
    return points.agg(F.coalesce(OPERATIONS[name]("value"), F.lit(0.0)).alias("result"), F.count("value").alias("count"))


def numbered(points: DataFrame, width: int = 86_400) -> DataFrame:
    """Points, without repeats, with ``place``, their number in their series from 0, and ``before``, the two times before.

    Spans of ``width`` seconds are numbered apart and joined with what the spans before hold, so no task sees a whole
    series: only its spans, one row each, meet in a window.
    """
    span = [*SERIES, "_span"]
    cut = points.withColumn("_span", F.floor(F.col("timestamp") / width))
    inside, back = Window.partitionBy(*span).orderBy("timestamp"), Window.partitionBy(*span).orderBy(F.desc("timestamp"))
    two = F.array_compact(F.array(F.lag("timestamp", 2).over(inside), F.lag("timestamp", 1).over(inside)))
    placed = cut.withColumns({"_own": F.row_number().over(inside) - 1, "_two": two})
    ends = cut.select(*span, "timestamp", F.row_number().over(back).alias("_r")).where("_r <= 2").groupBy(*span).agg(F.array_sort(F.collect_list("timestamp")).alias("_ends"))
    spans = cut.groupBy(*span).agg(F.count("*").alias("_n")).join(ends, span)
    earlier = Window.partitionBy(*SERIES).orderBy("_span")
    held = spans.select(
        *span,
        F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.flatten(F.collect_list("_ends").over(earlier.rowsBetween(-2, -1))).alias("_last"),
    )
    latest = lambda a: F.reverse(F.slice(F.reverse(a), 1, 2))
    joined = placed.join(held, span)
    return joined.select(*points.columns, (F.col("_base") + F.col("_own")).alias("place"), latest(F.concat("_last", "_two")).alias("before"))


def chunks(points: DataFrame, size: int = 1000) -> DataFrame:
    """Points with the number of their chunk: every ``size`` points of a series in time, for points without repeats."""
    return numbered(points).withColumn("chunk", F.floor(F.col("place") / size).cast("long")).drop("place", "before")


def coded_bits(points: DataFrame) -> DataFrame:
    """Of each series the bits that delta-of-delta coding takes for its times, for points without repeats.

    64 for each of the first two; then by the change of the difference: 1 if none, and 9, 12, 16 or 68 by its size.
    """
    change = F.col("timestamp") - 2 * F.get("before", F.lit(1)) + F.get("before", F.lit(0))
    bits = F.when(F.size("before") < 2, 64).when(change == 0, 1)
    for most, cost in ((64, 9), (256, 12), (2_048, 16)):
        bits = bits.when(change.between(-most, most - 1), cost)
    return numbered(points).groupBy(*SERIES).agg(F.sum(bits.otherwise(68)).alias("bits"))


def value_bits(points: DataFrame) -> DataFrame:
    """Of each series the bits that coding values by change takes, each day of it a block of its own.

    64 for a block's first value, then 1 if equal to the last, else 66. Values of one second come as they arrived.
    """
    before = Window.partitionBy(*SERIES, F.floor(F.col("timestamp") / 86_400)).orderBy("timestamp", "seq")
    cost = F.when(F.lag("value").over(before).isNull(), 64).when(F.lag("value").over(before) == F.col("value"), 1).otherwise(66)
    return points.select(*SERIES, cost.alias("bits")).groupBy(*SERIES).agg(F.sum("bits").alias("bits"))


def chunk_stats(points: DataFrame, size: int = 1000) -> DataFrame:
    """Start, end, sum, min, max and count of each chunk."""
    own = [F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count")]
    return chunks(points, size).groupBy(*SERIES, "chunk").agg(*own)


def catalog(points: DataFrame, *columns: str) -> DataFrame:
    return points.select(*columns).distinct()


def keys(points: DataFrame) -> DataFrame:
    return points.select(series_key(F.col("device_id"), F.col("metric_name")).alias("series_key")).distinct()
