"""Table schemas, vocabularies and well-known keys of the telemetry store."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, B, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Columns in query order: file columns, then the two partition columns, both strings.
LOGS = _struct(
    id=S, timestamp=TS, level=S, route=S, message=S, attributes=S, logger_name=S, file=S, line=I, correlation_id=S,
    stack_trace=T.ArrayType(S), exception_type=S, exception_message=S, service=S, date=S,
)
SPANS = _struct(
    id=S, correlation_id=S, parent_correlation_id=S, name=S, route=S, method=S, status_code=I, latency_ms=D, is_error=B, start_time=TS,
    end_time=TS, attributes=S, service=S, date=S,
)
METRICS = _struct(id=S, name=S, timestamp=TS, value=D, labels=S, service=S, date=S)
TABLES = {"logs": LOGS, "spans": SPANS, "metrics": METRICS}
PARTITIONS = ("service", "date")
#: The column whose UTC day is a row's ``date``.
EVENT_TIME = {"logs": "timestamp", "spans": "start_time", "metrics": "timestamp"}

#: The logger whose log rows carry HTTP requests in their attributes.
HTTP_LOGGER = "app.http"
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")
ERROR_LEVELS = ("error", "critical", "fatal")
STATUS_KEY, LATENCY_KEY = "http.status_code", "http.latency_ms"

_MAP = T.MapType(S, S)
_L = T.LongType()
#: One ingest batch on the wire (JSON): a service, its instance, and its events.
LOG_EVENT = _struct(
    event_id=S, service_name=S, timestamp_ns=_L, level=S, message=S, attributes=_MAP, logger_name=S, file=S, line=I, correlation_id=S,
    stack_trace=T.ArrayType(S), exception_type=S, exception_message=S,
)
SPAN_EVENT = _struct(
    event_id=S, correlation_id=S, parent_correlation_id=S, name=S, route=S, method=S, status_code=I, start_time_ns=_L, end_time_ns=_L, error=S,
    kind=I, attributes=_MAP,
)
METRIC_EVENT = _struct(event_id=S, name=S, timestamp_ns=_L, value=D, type=I, labels=_MAP, bucket_values=T.ArrayType(D))
BATCH = _struct(service_name=S, instance_id=S, batch_seq=_L, logs=T.ArrayType(LOG_EVENT), spans=T.ArrayType(SPAN_EVENT), metrics=T.ArrayType(METRIC_EVENT))
