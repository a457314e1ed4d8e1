"""Row shapes of the tables the jobs exchange.

Null convention for events: NULL means "the field does not exist for this kind
of line", an empty string means "the field exists but is empty".
"""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()

# Text fields of a normalized event, in column order.
EVENT_FIELDS = (
    "timestamp", "host", "user", "source_ip", "source_port", "destination_ip", "event_type",
    "process", "pid", "raw_message", "message", "mitre_tactic", "mitre_technique",
)

# Header of a structured case file.
CASE = T.StructType([
    T.StructField(name, _S)
    for name in ("timestamp", "host", "process", "event_type", "message", "source_ip",
                 "destination_ip", "user")
])

RULE = T.StructType([
    T.StructField("id", _S),
    T.StructField("name", _S),
    T.StructField("description", _S),
    T.StructField("severity", _S),
    T.StructField("condition", _S),
    T.StructField("patterns", T.ArrayType(_S)),
    T.StructField("threshold", T.IntegerType()),
    T.StructField("time_window", T.IntegerType()),
    T.StructField("mitre_tactic", _S),
    T.StructField("mitre_technique", _S),
    T.StructField("enabled", T.BooleanType()),
])

# Common shape of one provider's opinion about one address.
VERDICT = T.StructType([
    T.StructField("ip", _S),
    T.StructField("provider", _S),
    T.StructField("is_malicious", T.BooleanType()),
    T.StructField("confidence", T.IntegerType()),
    T.StructField("country", _S),
    T.StructField("country_code", _S),
    T.StructField("isp", _S),
    T.StructField("is_tor", T.BooleanType()),
    T.StructField("is_proxy", T.BooleanType()),
    T.StructField("is_vpn", T.BooleanType()),
    T.StructField("is_datacenter", T.BooleanType()),
    T.StructField("abuse_score", T.IntegerType()),
    T.StructField("report_count", T.IntegerType()),
    T.StructField("last_reported", _S),
    T.StructField("categories", T.ArrayType(_S)),
    T.StructField("tags", T.ArrayType(_S)),
])
