"""Deleted series: an append-only table of marks, what is masked by them, and their clearing when files are rewritten."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SERIES, TOMBSTONE
from . import points as P
from . import table

MARK = T.StructType([*TOMBSTONE.fields, T.StructField("cleared", T.BooleanType())])


class Tombstones:
    """Marks in the folder ``path``. A series is deleted while the last of its marks says so.

    Marks are only ever added, each with the time ``at`` it was made, so readers need no lock; of marks of one time
    a clearing counts as the later. Repeated marks change nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _add(self, series: DataFrame, at: int, cleared: bool) -> None:
        marks = series.select(*SERIES, F.lit(at).cast("long").alias("deleted_at"), F.lit(cleared).alias("cleared")).distinct()
        marks.write.mode("append").parquet(self.path)

    def write(self, series: DataFrame, at: int) -> None:
        """Delete the series of ``series`` (device_id, metric_name)."""
        self._add(series, at, False)

    def remove(self, series: DataFrame, at: int) -> None:
        """Let the series be written again."""
        self._add(series, at, True)

    def current(self) -> DataFrame:
        """(device_id, metric_name, deleted_at) of what is deleted now; no rows if nothing ever was."""
        try:
            marks = self.spark.read.schema(MARK).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], TOMBSTONE)
        last = marks.groupBy(*SERIES).agg(F.max(F.struct("deleted_at", "cleared")).alias("_m"))
        return last.where("NOT _m.cleared").select(*SERIES, "_m.deleted_at")

    def has(self, device: str, metric: str) -> bool:
        return not self.current().where((F.col("device_id") == device) & (F.col("metric_name") == metric)).isEmpty()


def append_alive(points: DataFrame, path: str, tombstones: Tombstones, buckets: int = 16) -> None:
    """Add points to a stored table, but none of series that are deleted now."""
    table.append(P.without_tombstones(points, tombstones.current()), path, buckets)


def delete(series: DataFrame, tombstones: Tombstones, at: int, pending: DataFrame | None = None) -> DataFrame | None:
    """Delete series: readers mask what is stored from now on, and ``pending`` points lose theirs."""
    tombstones.write(series, at)
    return None if pending is None else P.without_tombstones(pending, series)


def compact(spark: SparkSession, path: str, to: str, tombstones: Tombstones, at: int, buckets: int = 4) -> DataFrame:
    """Rewrite a stored table without its deleted series, then clear their marks, so that they may be written again.

    The marks' files are listed once, before the rewrite: what is deleted meanwhile keeps its mark and its rows.
    """
    gone = tombstones.current()
    kept = table.compact(spark, path, to, gone, buckets)
    tombstones.remove(gone, at)
    return kept
