"""Points from text: log lines in JSON, and lines of a serial port."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LOG_ENTRY

DEFAULT_DEVICE, DEFAULT_METRIC = "sensor_1", "temperature"
#: A log line of more bytes ends the reader's buffer and counts as malformed.
LONGEST_LINE = 64 * 1024


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON-lines log files; malformed, torn and overlong lines are skipped, as by ``parse_log``."""
    return parse_log(spark.read.text(path), "value")


def parse_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """The same for a column of lines, keeping the other columns; absent numbers are 0, as in the log's format."""
    entry = F.from_json(F.when(F.octet_length(column) < LONGEST_LINE, F.col(column)), LOG_ENTRY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    whole = lines.withColumn("_e", entry).where(F.col("_e").isNotNull() & F.rtrim(column).endswith("}") & F.coalesce("_e.device_id", "_e.metric_name", "_e.role").isNotNull())
    rest = [c for c in lines.columns if c != column]
    fields = [F.col(f"_e.{n}") if n not in ("timestamp", "value") else F.coalesce(f"_e.{n}", F.lit(0)).alias(n) for n in LOG_ENTRY.names]
    return whole.select(*rest, *fields)


def write_log(entries: DataFrame) -> DataFrame:
    """Log lines of entries, in the log's order of fields."""
    return entries.select(F.to_json(F.struct(*LOG_ENTRY.names)).alias("line"))


def sensor_line(line: Column) -> dict[str, Column]:
    """A serial line as a point: ``device,value``, else a word and a value of the default device; bad numbers are 0."""
    parts = F.split(line, ",")
    pair = F.size(parts) == 2
    device = F.when(pair, F.trim(parts[0])).otherwise(F.lit(DEFAULT_DEVICE))
    number = F.when(pair, F.trim(parts[1])).otherwise(F.regexp_extract(line, r"^\s*\S+\s+(\S+)", 1))
    return {"device_id": device, "metric_name": F.lit(DEFAULT_METRIC), "value": F.coalesce(number.try_cast("double"), F.lit(0.0))}


def sensor_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Points of serial lines (batch or stream), beside the other columns."""
    got = sensor_line(F.col(column))
    return lines.select(*[c for c in lines.columns if c != column], *(c.alias(n) for n, c in got.items()))

