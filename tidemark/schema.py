"""Row types of the engine."""

from pyspark.sql import types as T

#: A measurement as it is posted. Times are Unix seconds.
POINT = T.StructType([T.StructField("device_id", T.StringType()), T.StructField("metric_name", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("value", T.DoubleType())])
#: A log line: a point and whether it was stored as primary or replica.
LOG_ENTRY = T.StructType([*POINT.fields, T.StructField("role", T.StringType())])
#: What the engine works on: a point and its place in the order of arrival.
ARRIVED = T.StructType([T.StructField("seq", T.LongType()), *POINT.fields])
#: The same with the role in which a node was sent it.
ROLED = T.StructType([*ARRIVED.fields, T.StructField("role", T.StringType())])
NODE = T.StructType([T.StructField("id", T.StringType()), T.StructField("address", T.StringType()), T.StructField("http_port", T.IntegerType()), T.StructField("last_heartbeat", T.LongType()), T.StructField("status", T.StringType())])
TOMBSTONE = T.StructType([T.StructField("device_id", T.StringType()), T.StructField("metric_name", T.StringType()), T.StructField("deleted_at", T.LongType())])
#: The identity of a series; the key string is only derived from it.
SERIES = ["device_id", "metric_name"]
#: The identity of one arrival, the same in every copy of it: a series may get several points in a second.
ARRIVAL = [*SERIES, "timestamp", "seq"]
