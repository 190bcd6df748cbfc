"""Telemetry analytics on Spark: logs, HTTP/RPC spans and metrics."""

__version__ = "0.2.0"
