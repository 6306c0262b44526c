"""Column types of envelopes, events, alerts and dimensions."""
from __future__ import annotations

from pyspark.sql import types as T

RAW_LOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("source_ip", T.StringType()),
])

GEO = T.StructType([
    T.StructField("country_iso_code", T.StringType()),
    T.StructField("country_name", T.StringType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("location", T.StructType([
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ])),
])

THREAT = T.StructType([
    T.StructField("matched", T.BooleanType()),
    T.StructField("feed", T.StringType()),
    T.StructField("score", T.IntegerType()),
])

EVENT = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("event", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("category", T.ArrayType(T.StringType())),
        T.StructField("type", T.ArrayType(T.StringType())),
        T.StructField("dataset", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("action", T.StringType()),
    ])),
    T.StructField("source", T.StructType([
        T.StructField("ip", T.StringType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("mac", T.StringType()),
        T.StructField("geo", GEO),
        T.StructField("threat_intel", THREAT),
    ])),
    T.StructField("destination", T.StructType([
        T.StructField("ip", T.StringType()),
        T.StructField("port", T.IntegerType()),
    ])),
    T.StructField("network", T.StructType([
        T.StructField("protocol", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("packets", T.LongType()),
        T.StructField("name", T.StringType()),
    ])),
    T.StructField("host", T.StructType([
        T.StructField("hostname", T.StringType()),
        T.StructField("ip", T.ArrayType(T.StringType())),
    ])),
    T.StructField("user", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("observer", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("vendor", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("mac_vendor", T.StringType()),
    ])),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("message", T.StringType()),
    T.StructField("raw_message", T.StringType()),
])

ALERT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("event_count", T.IntegerType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
ALERT_COLUMNS = ALERT.fieldNames()

REQUEST = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("id", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("peer", T.StringType()),
    T.StructField("xff", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("user_id", T.StringType()),
])
