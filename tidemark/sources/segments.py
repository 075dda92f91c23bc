"""Files of a stored table as segments: their names, and what each of them holds. Spark's Parquet is the format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_segment_name
from ..operators import table
from ..schema import SERIES


def listing(files: DataFrame) -> DataFrame:
    """(name, series_key, sequence) of the files whose names are segments'."""
    key, sequence = parse_segment_name(F.col("name"))
    return files.select("name", key.alias("series_key"), sequence.alias("sequence")).where("series_key IS NOT NULL")


def round_trip(points: DataFrame, path: str) -> DataFrame:
    """``points`` written to a stored table and read back."""
    table.append(points, path)
    return table.read(points.sparkSession, path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(device_id, metric_name, file, count, checksum) of each series in each file of a stored table."""
    return table.files(table.read(spark, path)).select(*SERIES, "file", "count", "checksum")
